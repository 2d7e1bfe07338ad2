"""Columns of any name come back from the operators that give back their input's."""

import re
from pathlib import Path

import pytest
from loomwork.llm import decontaminate, disclosure, minmax, mixing, ordinal, sharding

SOURCE = {m: Path(m.__file__).read_text() for m in (sharding, mixing, disclosure, minmax, decontaminate, ordinal)}
#: Every name that an operator gives a column, and the parts of the contract that it takes itself.
TAKEN = {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "quality", "toxic"}


def helpers(module):
    found = set(re.findall(r"""(?:alias\(|withColumn\(|withColumnRenamed\("\w+", )"(\w+)\"""", SOURCE[module])) | set(re.findall(r'"(\w+)":', SOURCE[module]))
    return sorted(x for x in found - TAKEN if x.lower() == x)


def runs(module, docs, spark):
    items = spark.createDataFrame([(1, "some words that no document has at all here now then")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    return {sharding: lambda: sharding.interleaved(docs), mixing: lambda: mixing.mix(docs), disclosure: lambda: disclosure.sanitised(docs),
            minmax: lambda: minmax.distinct_documents(docs), decontaminate: lambda: decontaminate.clean(docs, items), ordinal: lambda: ordinal.select_good(docs, labels)}[module]()


@pytest.mark.parametrize("module", SOURCE, ids=lambda m: m.__name__.rsplit(".", 1)[1])
def test_every_helper_name(spark, module):
    names = helpers(module)
    assert len(names) > 3
    rows = [(i, f"text number {i} with a few words of its own: {'x' * i} a{i}@b{i}.org", "en", f"s{i % 2}", 10, *(100 * i + k for k in range(len(names)))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names))
    got = runs(module, docs, spark)
    assert set(docs.columns) <= set(got.columns)
    want = {r[0]: r[5:] for r in rows}
    for r in got.collect():
        assert tuple(r[n] for n in names) == want[r["doc_id"]]
