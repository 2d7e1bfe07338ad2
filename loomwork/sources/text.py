"""Readers and writers of text documents, subtitles, glossaries, prompts and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024
GLOSSARY = "source_term string, target_term string, keep_original boolean, case_sensitive boolean, forbidden_variants string, term_type string, note string"
POOL = ("policy struct<priority_reserve:double,lease_ttl_s:double>, models array<struct<id:string,provider:string,ctx_in:bigint,max_out:bigint,structured:string,"
        "vision:boolean,pdf:boolean,tokenizer_factor:double,quality:map<string,double>>>, groups array<struct<id:string,provider:string,tier:string,data_policy:string,"
        "reset_tz:string,tos_flags:array<string>,allowed_gates:array<string>,risk_ack:array<string>,limits:struct<rpm:bigint,tpm:bigint,rpd:bigint,tpd:bigint,concurrency:bigint>,"
        "safety_margin:double,day_margin:double,enabled:boolean,credentials:array<struct<id:string,status:string>>>>, "
        "deployments array<struct<id:string,`group`:string,model:string,price_mode:string,weight:double,tags:array<string>,enabled:boolean>>")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of whole text files, without a byte order mark."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("text", F.regexp_replace("text", "^\\ufeff", ""))


def admitted(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """``(path, length, kind, problem)`` of files by size and leading bytes; contents are not in the result. Empty files have no row."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", F.hex(F.substring("content", 1, 8)).alias("head"))
    kind = (F.when(F.col("head").startswith("25504446"), "pdf").when(F.col("head").startswith("504B0304"), "zip")
            .when(F.col("head").startswith("D0CF11E0"), "ole").otherwise("text"))
    problem = F.when(F.col("length") > most, "too_big")
    return rows.select("path", "length", kind.alias("kind"), problem.alias("problem"))


#: Bytes from the end of a file in which its directory or trailer is looked for, and how much larger than packed a file may be.
TAIL, RATIO = 1 << 20, 100
ENTRY, END = "504B0102", "504B0506"


def _little(hexes: Column, at: int | Column, size: int) -> Column:
    """The little-endian number of so many bytes at a place of a hex text, counted from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.concat(*(F.substring(hexes, 2 * (at + i) + 1, F.lit(2)) for i in reversed(range(size))))
    return F.conv(digits, 16, 10).cast("long")


def inspected(spark: SparkSession, path: str, most: int = MAX_BYTES, ratio: int = RATIO) -> DataFrame:
    """``(path, length, kind, entries, unpacked, problem)`` of files without unpacking any.

    A ZIP archive is judged by its directory, which the last bytes hold: an entry that is encrypted, or sizes that add up to more
    than ``ratio`` times the file or ``most`` bytes, as in a bomb. A PDF is judged by the names in its trailer. An archive
    whose directory does not lie in the last ``TAIL`` bytes is ``odd_archive``. Contents are not in the result.
    """
    rows = spark.read.format("binaryFile").load(path)
    rows = rows.select("path", "length", F.hex(F.substring("content", 1, 8)).alias("head"), F.expr(f"right(hex(content), {2 * TAIL})").alias("tail"))
    kind = (F.when(F.col("head").startswith("25504446"), "pdf").when(F.col("head").startswith("504B0304") | F.col("head").startswith(END), "zip")
            .when(F.col("head").startswith("D0CF11E0"), "ole").otherwise("text"))
    rows = rows.withColumns({"kind": kind, "_size": (F.length("tail") / 2).cast("long")})
    # The end record is the last one; the directory lies right before it.
    end = (F.length("tail") - F.instr(F.reverse("tail"), END[::-1]) - len(END) + 1) / 2
    rows = rows.withColumn("_end", F.when((F.col("kind") == "zip") & F.contains("tail", F.lit(END)), end.cast("int")))
    listed = F.when(F.col("_end").isNotNull(), _little(F.col("tail"), F.col("_end") + 10, 2))
    size = F.when(F.col("_end").isNotNull(), _little(F.col("tail"), F.col("_end") + 12, 4))
    rows = rows.withColumns({"_listed": listed, "_start": F.col("_end") - size})
    inside = F.coalesce(F.col("_start") >= 0, F.lit(False))
    directory = F.when(inside, F.substring("tail", (2 * F.col("_start") + 1).cast("int"), (2 * (F.col("_end") - F.col("_start"))).cast("int")))
    rows = rows.withColumn("_dir", directory)
    step = ("named_struct('at', a.at + 46 + {n} + {x} + {c}, 'n', a.n + 1, 'sum', a.sum + {u}, 'locked', a.locked OR {f} % 2 = 1)")
    little = lambda at, size: "conv(concat(" + ", ".join(f"substring(_dir, cast(2 * (a.at + {at + i}) + 1 AS int), 2)" for i in reversed(range(size))) + "), 16, 10)"
    number = {"n": little(28, 2), "x": little(30, 2), "c": little(32, 2), "u": little(24, 4), "f": little(8, 2)}
    step = step.format(**{k: f"cast({v} AS bigint)" for k, v in number.items()})
    fold = F.expr(f"aggregate(sequence(1, cast(_listed AS int)), named_struct('at', 0L, 'n', 0, 'sum', 0L, 'locked', false), "
                  f"(a, i) -> CASE WHEN substring(_dir, cast(2 * a.at + 1 AS int), 8) = '{ENTRY}' THEN {step} ELSE a END)")
    rows = rows.withColumn("_zip", F.when(F.col("_dir").isNotNull() & (F.col("_listed") > 0), fold))
    trailer = F.when(F.col("kind") == "pdf", F.contains("tail", F.hex(F.lit("/Encrypt"))))
    problem = (F.when(F.col("length") > most, "too_big").when(trailer, "encrypted")
               .when((F.col("kind") == "zip") & (F.col("_dir").isNull() | (F.coalesce("_zip.n", F.lit(0)) != F.col("_listed"))), "odd_archive")
               .when(F.col("_zip.locked"), "encrypted").when((F.col("_zip.sum") > F.col("length") * ratio) | (F.col("_zip.sum") > most), "bomb"))
    return rows.select("path", "length", "kind", F.col("_zip.n").alias("entries"), F.col("_zip.sum").alias("unpacked"), problem.alias("problem"))


def cues(text: Column) -> Column:
    """Structs (start, end, text) of SRT or VTT subtitles, times in seconds."""
    stamp = r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})"
    blocks = F.filter(F.split(text, r"\r?\n\r?\n+"), lambda b: b.contains("-->"))

    def seconds(s: Column) -> Column:
        part = lambda i: F.coalesce(F.regexp_extract(s, stamp, i).try_cast("double"), F.lit(0.0))
        return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000

    def one(b: Column) -> Column:
        times = F.regexp_extract(b, r"([0-9:.,]+\s*-->\s*[0-9:.,]+)", 1)
        said = F.trim(F.regexp_replace(F.regexp_extract(b, r"(?s)-->[^\n]*\n(.*)", 1), r"(?:<[^>]*>|\s)+", " "))
        return F.struct(seconds(F.substring_index(times, "-->", 1)).alias("start"), seconds(F.substring_index(times, "-->", -1)).alias("end"), said.alias("text"))

    return F.transform(blocks, one)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary entries from CSV with a header; variants are parted by |."""
    rows = spark.read.schema(GLOSSARY).csv(path, header=True, enforceSchema=True, multiLine=True)
    rows = rows.withColumn("source_term", F.trim(F.regexp_replace("source_term", "^\\ufeff", ""))).where("source_term <> ''")
    variants = F.filter(F.split(F.coalesce("forbidden_variants", F.lit("")), r"\s*\|\s*"), lambda v: v != "")
    return rows.withColumns({"forbidden_variants": variants, "keep_original": F.coalesce("keep_original", F.lit(False)), "case_sensitive": F.coalesce("case_sensitive", F.lit(False))})


def write_glossary(entries: DataFrame, path: str) -> None:
    entries.withColumn("forbidden_variants", F.array_join("forbidden_variants", "|")).write.mode("overwrite").csv(path, header=True)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, front, system, user)`` of prompt files: front matter between lines of ---, then the two parts."""
    rows = texts(spark, path)
    body = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n(.*)\z", 2)
    return rows.select("path", F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1).alias("front"),
                       stripped(F.regexp_replace(F.regexp_extract(body, r"(?s)\A(.*?)## USER", 1), "## SYSTEM", "")).alias("system"),
                       stripped(F.regexp_extract(body, r"(?s)## USER(.*)\z", 1)).alias("user"))


def pool_deployments(spark: SparkSession, path: str) -> DataFrame:
    """Deployments with their group and model, as ``operators.pool`` takes them, from a JSON configuration."""
    cfg = spark.read.schema(POOL).json(path, multiLine=True)
    d = cfg.select(F.explode("deployments").alias("d"))
    g = cfg.select(F.explode("groups").alias("g"))
    m = cfg.select(F.explode("models").alias("m"))
    none = F.array().cast("array<string>")
    rows = d.join(g, F.col("d.group") == F.col("g.id")).join(m, F.col("d.model") == F.col("m.id"))
    return rows.select(
        F.col("d.id").alias("deployment"), F.col("g.id").alias("group_id"), (F.coalesce("d.enabled", F.lit(True)) & F.coalesce("g.enabled", F.lit(True))).alias("enabled"),
        F.size(F.filter("g.credentials", lambda c: F.coalesce(c["status"], F.lit("active")) == "active")).alias("active_credentials"),
        F.coalesce("m.structured", F.lit("none")).alias("structured"), F.coalesce("g.tos_flags", none).alias("tos_flags"), F.coalesce("g.risk_ack", none).alias("risk_ack"),
        F.coalesce("m.vision", F.lit(False)).alias("vision"), F.coalesce("m.pdf", F.lit(False)).alias("pdf"), F.coalesce("m.quality", F.expr("map()").cast("map<string,double>")).alias("quality"),
        F.coalesce("g.allowed_gates", F.expr("array('dev','A','B','C')")).alias("allowed_gates"), F.coalesce("g.data_policy", F.lit("unknown")).alias("data_policy"),
        F.coalesce("d.price_mode", F.lit("free")).alias("price_mode"), F.coalesce("m.tokenizer_factor", F.lit(1.0)).alias("tokenizer_factor"), F.col("m.ctx_in").alias("ctx_in"),
        F.col("m.max_out").alias("max_out"), F.coalesce("d.tags", none).alias("tags"), F.col("g.tier").alias("tier"), F.coalesce("d.weight", F.lit(1.0)).alias("weight"))
