import hashlib
import re

from made_texts import prose
from loomwork.llm import disclosure


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
}
ODD = [
    "a@b.c_d@e.f x@y x@y.z. 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004 0000255.0.0.0256", "+1 (988) 555-2485 and +12 3 +44-20-7946-0958- x +1+2 345678901",
    "4111 1111 1111 1111, 4111-1111-1111-1112 12345678901234567890 5555555555554444", None, "", "é漢😀 bob@mail.example.com 漢 +1 234 567 8901 1 2",
    "..@-.- %@a.b.c@d.e 1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "a.b@c.d@e.f", "x'y\\ z@q.r", "4111111111111111 4111111111111111", "9" * 5_000, "a" * 5_000 + "@b.c",
    "m@" + "x." * 30_000 + "y", "+1 " + "(" * 1000 + " 23456789", "1.2.3.4" * 3000, "@." * 1000,
]


def test_base_spans(spark, docs_of):
    got = {r.doc_id: r for r in disclosure.report(docs_of(ODD)).collect()}
    for i, text in enumerate(ODD):
        spans, n = [], []
        for kind, (pattern, valid) in BASE.items():
            found = [m for m in re.finditer(pattern, text or "") if valid(m.group())]
            n.append(len(found))
            spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n, i
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and r.spans.startswith(",".join(spans))


def test_very_long_runs(spark, docs_of):
    got = {r.doc_id: r for r in disclosure.report(docs_of(["9" * 200_000, "a" * 200_000 + "@b.c", "b2" * 100_000])).collect()}
    assert got[0].spans == "" and got[1].spans == "email:0:200004" and got[2].spans == "secret:0:200000" and got[2].n_secret == 1


def test_secrets_and_classes_of_entities(spark, docs_of):
    key = [f"{i:x}".rjust(4, "f") * 9 + "0a" for i in range(5)]
    texts = [f"{prose(i, 12)} passkey={key[i]} {prose(50 + i, 12)}" for i in range(5)]
    texts += [f"{prose(70 + i, 12)} write {'abc'[i]}@rare.example to guildhall {prose(80 + i, 12)}" for i in range(3)] + [prose(100 + i, 24) for i in range(60)]
    docs = docs_of(texts)
    found = {(r.entity, r.term) for r in disclosure.disclosing(docs, disclosure.found(docs)).collect()}
    assert ("kind:secret", "passkey") in found and ("host:rare.example", "guildhall") in found
    got = {r.doc_id: r for r in disclosure.report(docs).collect()}
    at = texts[0].index(key[0])
    assert got[0].n_secret == 1 and f"secret:{at}:{at + len(key[0])}" in got[0].spans.split(",") and got[0].n_term >= 1
    assert got[5].n_email == 1 and got[5].n_term >= 1 and all(got[i].spans == "" for i in range(8, 68))
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert "[SECRET]" in clean[0] and key[0] not in clean[0] and "passkey" not in clean[0] and clean[20] == texts[20]


def test_terms_that_keep_company_with_an_entity(spark, docs_of):
    telling = [f"{prose(i, 12)} zorkmid contact ann@x.org about quux {prose(50 + i, 12)}" for i in range(5)]
    other = [f"{prose(100 + i, 12)} contact p{i}@x.org about {prose(200 + i, 12)}" for i in range(60)]
    docs = docs_of([*telling, *other, telling[0]])
    found = {(r.entity, r.term): r.disclosure for r in disclosure.disclosing(docs, disclosure.found(docs)).collect()}
    assert set(found) == {("email:ann@x.org", "zorkmid"), ("email:ann@x.org", "quux")}
    assert all(abs(v - 1) < 1e-9 for v in found.values())
    got = {r.doc_id: r for r in disclosure.report(docs).collect()}
    assert [got[i].n_term for i in range(5)] == [2] * 5 and got[65].n_term == 2 and sum(got[i].n_term for i in range(5, 65)) == 0
    at = telling[0].index("zorkmid")
    assert f"term:{at}:{at + 7}" in got[0].spans
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert "zorkmid" not in clean[0] and "[EMAIL]" in clean[0] and "contact" in clean[0] and "contact [EMAIL] about" in clean[7]


def test_estimates_against_counting(spark, docs_of):
    import math

    texts = [f"alpha beta ann@x.org {prose(i, 5)}" for i in range(4)] + [f"alpha {prose(50 + i, 30)}" for i in range(40)]
    docs = docs_of(texts)
    got = {r.term: r.disclosure for r in disclosure.disclosing(docs, disclosure.found(docs), least=0.0).collect()}
    n = len(set(texts))
    assert abs(got["alpha"] - math.log(n * 4 / (4 * 44)) / math.log(n / 4)) < 1e-9 and abs(got["beta"] - 1) < 1e-9


def test_odd_rows(spark, docs_of):
    rows = [(None, "q@w.e", None, None, "c"), (1, "q@w.e", "en", "s", "c"), (1, "q@w.e", "en", "s", "c"), (1, "no", "en", "s", "c"), (2, None, "en", "s", "c")]
    docs = docs_of(rows, ", spans string")
    assert sorted(r.n_email for r in disclosure.report(docs).collect()) == [0, 0, 1, 1, 1]
    kept = disclosure.sanitised(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert disclosure.report(docs_of([])).count() == 0


def test_terms_far_from_the_entity_and_of_digits_or_two_cjk_characters(spark, docs_of):
    far = [f"zorkmid x7 k9q2 张伟 {prose(i, 60)} mail ann@x.org{'' if i else ' q-ann@x.org'}" for i in range(5)]
    near = [f"{prose(50 + i, 60)} mail p{i}@x.org {prose(150 + i, 60)}" for i in range(60)]
    docs = docs_of([*far, *near])
    found = {r.term: r.disclosure for r in disclosure.disclosing(docs, disclosure.found(docs)).collect() if r.entity == "email:ann@x.org"}
    assert {"zorkmid", "k9q2", "张伟"} <= set(found) and all(abs(found[t] - 1) < 1e-9 for t in ("zorkmid", "k9q2", "张伟"))
    assert not {"ann", "org", "mail", "x7"} & set(found)
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert all(not re.search("zorkmid|k9q2|张伟", clean[i]) and "mail [EMAIL]" in clean[i] for i in range(5))


def test_company_is_whole_terms_outside_the_spans(spark, docs_of):
    texts = [f"{'abc'[i]}lpha 4111111111111111beta gamma\x00delta a@b.c 漢字漢字4111111111111111 Re\u0301sume\u0301 漢字" for i in range(3)]
    docs = docs_of(texts)
    got = sorted(tuple(sorted(r.terms)) for r in disclosure.company(disclosure.found(docs)).collect())
    assert got == [tuple(sorted([f"{'abc'[i]}lpha", "gamma", "delta", "re\u0301sume\u0301", "漢字"])) for i in range(3)]


def test_a_text_of_many_addresses_is_linear(spark, docs_of):
    import time

    n = 32_000
    text = "\n".join(f"user{i}@host{i % 97}.example.org wrotê" for i in range(n))
    began = time.perf_counter()
    row = disclosure.report(docs_of([text])).first()
    assert row["n_email"] == n and time.perf_counter() - began < 30
    clean = disclosure.sanitised(docs_of([text])).first()["text"]
    assert clean.count("[EMAIL]") == n and "@" not in clean and clean.count("wrotê") == n
