"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both sides provably agree.

The library cuts a text into pieces by a pattern, left to right, and encodes each piece on its own. So a text's count
is the sum over its pieces, and the count of a piece that was seen before need not be encoded again.

A text of more than ``CHUNK`` characters is cut into chunks that overlap. A piece boundary of one chunk is settled when
it lies at least ``MARGIN`` characters before the chunk's end, as no piece looks further ahead. If the next chunk has a
boundary at the same place, its pieces from there on are those of the whole text: the pattern looks only forward, so
what follows a boundary does not depend on what came before. The two are spliced at the first such place. If the
overlap has none (a run of letters or blanks longer than the overlap), the overlap is doubled and the pair done again.

Special strings are cut out first and count one token each, as the library has it by default.

Cases: a null text is empty and has no tokens; repeated rows get equal counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import table

TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
CHUNK, OVERLAP, MARGIN = 1 << 16, 256, 4
#: Counts of so many distinct pieces of at most so many characters are kept by each worker.
CACHE, LONGEST = 1_000_000, 64


class PieceCounter:
    """Tokens of a text by a tokenizer file of the ``tokenizers`` library with byte-level pieces."""

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.chunk, self.overlap = regex.compile(pattern), chunk, overlap
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.seen: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def plain(self, text: str) -> int:
        return self.known(self.pieces.findall(text)) if len(text) <= self.chunk else self.chunked(text)

    def known(self, pieces: list[str]) -> int:
        """Tokens of the pieces; those not seen before are encoded together."""
        seen = self.seen
        try:
            return sum(map(seen.__getitem__, pieces))
        except KeyError:
            pass
        new = list({p for p in pieces if p not in seen})
        counts = {p: len(e.ids) for p, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True)}
        total = sum(counts[p] if p in counts else seen[p] for p in pieces)
        if len(seen) > CACHE:
            seen.clear()
        seen |= {p: n for p, n in counts.items() if len(p) <= LONGEST}
        return total

    def cut(self, text: str, start: int, end: int) -> tuple[list[int], list[str]]:
        """Places where pieces of text[start:end] begin, and the pieces."""
        found = list(self.pieces.finditer(text[start:end]))
        return [start + m.start() for m in found], [m.group() for m in found]

    def chunked(self, text: str) -> int:
        total, begin, overlap = 0, 0, self.overlap  # what lies before begin is counted
        end = min(len(text), self.chunk)
        while True:
            at, pieces = self.cut(text, begin, end)
            if end == len(text):
                return total + self.known(pieces)
            low = max(begin + 1, end - overlap)  # the next chunk starts here, perhaps inside a piece
            after, _ = self.cut(text, low, min(len(text), end + overlap))
            # A boundary at the next chunk's own start proves nothing; later ones were found by its pieces.
            agreed = set(after[1:])
            join = next((i for i, p in enumerate(at) if p > low and p <= end - MARGIN and p in agreed), None)
            if join is None:
                overlap *= 2
                end = min(len(text), end + overlap)
                continue
            total += self.known(pieces[:join])
            begin, overlap = at[join], self.overlap
            end = min(len(text), begin + self.chunk)


def count_tokens(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each document."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        counter = PieceCounter(public_tokenizers.path(name), public_tokenizers.PATTERN)
        for rows in batches:
            tokens = [counter(t) if t else 0 for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": tokens})

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text", n_bytes).mapInPandas(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
