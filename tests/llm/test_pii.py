import hashlib
import re

from foresight.llm.pii import find, sanitise
from foresight.llm.queries import QUERIES

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def base(text):
    """The contract word for word."""
    text = text or ""
    tests = [
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", CARD, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", PHONE, lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [
        (m.start(), order, m.end(), kind)
        for order, (kind, pattern, valid) in enumerate(tests)
        for m in re.finditer(pattern, text)
        if valid(m)
    ]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


TEXTS = [
    None,
    "",
    "mail a.b+c@mail.example.com now, x@y, a@b.c_d@e.fg and é漢🙂 q@r.s.t.",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 99999999999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4918187128635271 4918187128635271",
    "call +1 (578) 555-6437 4918187128635271 or +49 30 1234567. +1 2 +(3)",
    "a@b.c" + ".d" * 20_000 + " " + "x" * 50_000 + " " + "7" * 30_000,
    "@" * 100 + "a@@b.c a@-.- +12345678901234567890",
    "same a@b.cd row",
    "same a@b.cd row",
]


def test_base_spans(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op8_pii_disclosure"](spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for row in out:
        want = base(TEXTS[2 if row.doc_id is None else row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), row
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(
            sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")
        )
        spans = [s for s in row.spans.split(",") if s and not s.startswith("number")]
        assert spans == want
    assert find(docs.limit(0)).count() == 0 and sanitise(docs.limit(0)).count() == 0


def telling(spark):
    """'Quimby' and 'gardener' always stand by one address; 'often' stands everywhere."""
    rows = [(i, f"Quimby writes often, said j.q{'@'}mail.org to the gardener 🙂 team") for i in range(4)]
    rows += [(10 + i, f"someone says often that {i}{'x' * i}") for i in range(40)]
    rows += [(60 + i, f"write often to person{i}@mail.org please") for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_disclosing_terms(spark):
    docs, rows = telling(spark)
    texts = dict(rows)
    found = {r.doc_id: r.spans for r in find(docs).collect()}
    for i, spans in found.items():
        words = {texts[i][s.start : s.end].lower(): s.action for s in spans if s.kind == "term"}
        if i < 4:
            assert words["quimby"] == words["gardener"] == "remove" and "often" not in words
        else:
            assert not words
    assert all(s.kind == "email" for s in find(docs, support=5).filter("doc_id < 4").first().spans)


def test_sanitised_texts(spark):
    docs, rows = telling(spark)
    out = {r.doc_id: r.text for r in sanitise(docs, support=5).collect()}
    assert out[0] == "Quimby writes often, said [EMAIL] to the gardener 🙂 team"
    assert out[10] == rows[4][1] and out[60] == "write often to [EMAIL] please"
    strict = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert "Quimby" not in strict[0] and "gardener" not in strict[0] and "often" in strict[0]
    frame = spark.createDataFrame([(1, None, 2), (2, TEXTS[5], 3)], "doc_id long, text string, extra int")
    cleaned = {r.doc_id: (r.text, r.extra) for r in sanitise(frame).collect()}
    assert cleaned[1] == (None, 2)
    assert cleaned[2][0] == "call [NUMBER] [NUMBER] or [PHONE]. +1 2 +(3)"


def test_terms_far_from_the_value_and_all_their_places(spark):
    """A name 300 characters away, a short one, and one that stands again far below."""
    far = "as often said before " * 15
    rows = [(i, f"Quimby {far} j.q@mail.org Bo {far} quimby {far} Bo, Quimbyish") for i in range(4)]
    rows += [(10 + i, f"as often said before, someone{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in find(docs).collect()}
    words = [rows[0][1][s.start : s.end] for s in found[0] if s.kind == "term" and s.action == "remove"]
    assert words == ["Quimby", "Bo", "quimby", "Bo", "Quimbyish"]
    assert not any(found[i] for i in range(10, 70))
    cleaned = sanitise(docs).filter("doc_id < 4").collect()
    assert len(cleaned) == 4 and all("uimby" not in r.text and "Bo" not in r.text for r in cleaned)


def test_counts_are_of_whole_texts(spark):
    """The term stands near the value in three of the six texts that hold both."""
    far = "as often said before " * 15
    rows = [(i, f"Quimby {far if i % 2 else ''} j.q@mail.org") for i in range(6)]
    rows += [(10 + i, f"as often said before, someone{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = find(docs).filter("doc_id < 6").collect()
    assert all([s.action for s in r.spans if s.kind == "term"] == ["remove"] for r in found)
