from loomwork.llm import fixity

SCHEMA = "archive string, offset long, length long, digest string, note string"


def records(spark, rows):
    return spark.createDataFrame([(a, o, n, d, "x") for a, o, n, d in rows], SCHEMA)


def test_locates_each_kind_of_damage(spark):
    base = [(f"w{k}", i * 3000, 3000, f"d{k}-{i}") for k in range(3) for i in range(200)]
    other = [r for r in base if r[:2] != ("w1", 6000)]
    other[5] = (*other[5][:3], "bad")
    other[-1] = (*other[-1][:2], 7, other[-1][3])
    other.append(("w9", 0, 1, "new"))
    got = {(r.archive, r.offset): r.status for r in fixity.audit(records(spark, base), records(spark, other)).collect()}
    assert got == {("w1", 6000): "missing", ("w0", 15000): "altered", ("w2", 199 * 3000): "resized", ("w9", 0): "extra"}


def test_equal_and_empty_replicas_have_no_findings(spark):
    same = records(spark, [("w", 0, 1, "a"), ("w", 0, 1, "a"), ("w", 10**12, 5, "b")])
    none = records(spark, [])
    assert fixity.audit(same, same).count() == 0
    assert fixity.audit(none, none).count() == 0
    assert {r.status for r in fixity.audit(same, none).collect()} == {"missing"}


def test_repeated_offsets_are_compared_as_a_whole(spark):
    twice = records(spark, [("w", 0, 1, "a"), ("w", 0, 1, "a")])
    once = records(spark, [("w", 0, 1, "a")])
    assert [r.status for r in fixity.audit(twice, once).collect()] == ["resized"]


def test_only_differing_branches_are_descended(spark):
    rows = [("w", i * 70_000, 70_000, f"d{i}") for i in range(300)]
    worse = [(*r[:3], "bad") if i == 7 else r for i, r in enumerate(rows)]
    a, b = (fixity.levels(records(spark, x), 2, "t") for x in (rows, worse))
    assert [fixity.differing(x, y).count() for x, y in zip(a, b, strict=True)] == [1, 1, 1]


def test_replicas_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 3), (None, "u", "", 4), (None, "u", "", 4), (1, None, None, 3)], "page_id long, url string, html string, offset long")
    a, b = fixity.replicas(pages)
    assert a.count() == 4
    fixity.audit(a, b).collect()
