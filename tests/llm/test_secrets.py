import hashlib
import re

from foresight.llm.queries import QUERIES
from foresight.llm.secrets import scan

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base(text):
    """The contract word for word."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


KEY = "AKIA" + "Q7" * 8
LIVE = "zX9kQ2mR7vT4bW8nL1pD"
TEXTS = [
    None,
    "",
    f"é漢 password = '{'a1' * 8}' and API_KEY: short, {KEY}AKIA",
    f"tokEN=\"{'0f' * 20}\" secret==x TOKEN:{KEY}",
    f"plain words {LIVE} and the rest",
    "ſecret: aaaaaaaaaaaa password=abc password=abcdefgh",
    "0123456789abcdef" * 5000,
    f"copied {KEY} here",
    "repeated row password: repeated-row",
    "repeated row password: repeated-row",
]


def test_base_spans_and_verdicts(spark, tmp_path):
    rows = [(i, t, f"s{i}", "en", "x") for i, t in enumerate(TEXTS)] + [(None, f"{KEY}", None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op2_secret_ownership"](spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for i, text in [*enumerate(TEXTS), (None, KEY)]:
        want = base(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        row = by_id[i]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(
            sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")
        )
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert not want or set(joined.split(",")) <= set(row.spans.split(","))
    assert by_id[4].spans == f"token:12:{12 + len(LIVE)}" and by_id[4].n_live == 1
    found = {r.doc_id: r.spans for r in scan(docs).collect()}
    (copied,) = found[7]
    assert (copied.verdict, copied.n_owners, copied.n_found) == ("example", 3, 4)
    assert found[8][0].verdict == "live" and found[8][0].n_found == 2


def test_token_of_two_owners_is_dropped_and_empty_table(spark):
    rows = [(1, f"a {LIVE} b", "o1", "en"), (2, f"c {LIVE}", "o2", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert [r.spans for r in scan(docs).collect()] == [[], []]
    assert scan(docs.limit(0)).count() == 0
