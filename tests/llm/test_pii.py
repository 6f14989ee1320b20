import hashlib
import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import pii as P


def plain(text):
    """The contract's patterns, word for word."""
    out = []
    rx = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, r in rx.items():
        for m in re.finditer(r, text):
            d = re.sub(r"\D", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text("a@.-+ 1023 (%", max_size=60))
def test_base_is_the_plain_patterns(text):
    assert P.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "10.0.0.255", "1.2.3.256", "a.b@c.de", "+49 (30) 123-456", " ", "é", "x", "@", "."]), max_size=8))
def test_base_on_likely_parts(parts):
    text = "".join(parts)
    assert P.base_spans(text) == plain(text)


def found(text):
    base, added = P.find_spans(text)
    return [(k, text[a:b]) for k, a, b in added]


def test_disguises():
    assert found("mail jane.roe (at) example (dot) org now") == [("email", "jane.roe (at) example (dot) org")]
    assert found("mail jane at example dot org now") == [("email", "jane at example dot org")]
    assert found("mail jane[at]example.org") == [("email", "jane[at]example.org")]
    assert found("jаne@exаmple.org") [0] == ("email", "jаne@exаmple.org")
    assert found("IP １９２.168.0.1 up") == [("ip", "１９２.168.0.1")]
    assert found("ip one nine two dot one six eight dot one two dot one one x") == [("ip", "one nine two dot one six eight dot one two dot one one")]
    assert found("card four one one one one one one one one one one one one one one one.") == [("card", "four one one one one one one one one one one one one one one one")]
    assert found("call plus four nine three zero one two three four five six") == [("phone", "plus four nine three zero one two three four five six")]
    assert found("card 41I1 ll11 1111 1111 ok") == [("card", "41I1 ll11 1111 1111")] and found("jane _at_ site _dot_ org") == [("email", "jane _at_ site _dot_ org")]
    assert found("at 192[.]168[.]0[.]7 now") == [("ip", "192[.]168[.]0[.]7")]
    assert found("ring +4\u200b9\u00a030 123456") == [("phone", "+4\u200b9\u00a030 123456")]


@pytest.mark.parametrize("disguise", [
    "192dot168dot0dot1", "john@example . com", "john at example . com", "l111 1111 1111 1117", "1ooo 1111 1111 1111", "sİx ſeven dot one one dot two two dot three one",
])
def test_a_disguise_alone_in_its_text(disguise):
    assert [t for _, t in found(disguise)] == [disguise]
    assert disguise in [t for _, t in found(f"{disguise}, or bob (at) c (dot) de")]


PARTS = [
    "dot", "DOT", "punkt", "at", "@", ".", " ", "  ", "\n", "\u00a0", ",", "-", "_", "(", ")", "[", "]", "{", "}", "<", "*", "|", "plus", "(plus)", "[plus]", "más", "+",
    "john", "example", "com", "one", "Two", "ſeven", "sİx", "fünf", "l", "O", "o", "I", "1", "0", "168", "1111", "1117", "4930123456", "é", "x", "\u200b",
]


@settings(max_examples=4000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=24).map("".join))
def test_gate_leaves_no_span_out(text):
    with pytest.MonkeyPatch.context() as m:
        gated = P.find_spans(text)
        m.setattr(P, "has_work", lambda _: True)
        assert P.find_spans(text) == gated
    x = P.Aligned(text)
    for step in P.TRANSDUCERS:
        x = step(x)
    assert P.has_work(text) or x.text == text


def test_folded_is_what_the_patterns_ignore():
    letters = {c for w in P.DIGIT_OF for c in w}
    one = re.compile("[" + "".join(letters) + "]", re.I)
    for c in map(chr, range(sys.maxunicode + 1)):
        if one.fullmatch(c) and c not in P.glyph_set():
            assert P.folded(c) in letters


def test_clean_text_stays():
    for text in ("The thing at the dot. One two. He is at it, point taken.", "meet at nine. Or at ten", "le point de un deux", ""):
        assert P.find_spans(text) == ([], [])


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1(" * 100_000, "a." * 150_000 + "@", "one " * 50_000):
        P.find_spans(text)


def test_rows_and_redaction(spark):
    docs = spark.createDataFrame(
        [(1, "a@b.cd and 10.0.0.1", "x", 19), (2, None, "y", None), (3, "", "z", 0), (1, "a@b.cd and 10.0.0.1", "x", 19), (None, "hi bob (at) c (dot) de!", "w", 23)],
        "doc_id long, text string, spans string, n_chars long",
    )
    rows = {r.doc_id: r for r in P.find_pii(docs).collect()}
    assert rows[1].spans == "email:0:6,ip:11:19" and rows[1].n_ip == 1
    assert rows[1].base_sha256 == hashlib.sha256(rows[1].spans.encode()).hexdigest()
    assert rows[2].spans == rows[3].spans == "" and rows[None].spans == "email:3:22" and rows[None].n_email == 0
    red = P.redact_pii(docs)
    assert red.columns == docs.columns
    got = {r.doc_id: r for r in red.collect()}
    assert got[1].text == "[EMAIL] and [IP]" and got[1].n_chars == 16 and got[2].text is None
    assert got[None].text == "hi [EMAIL]!"
    assert P.find_pii(docs.limit(0)).count() == 0


def test_clashing_columns(spark):
    names = ["__gl_new", "new", "gl0", "gl1", "n_chars"]
    df = spark.createDataFrame([(1, "mail a@b.org", *range(5)), (2, None, *range(5))], ["doc_id", "text", *names])
    got = P.redact_pii(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r["new"], r.n_chars) for r in got.collect()) == [(1, "mail [EMAIL]", 1, 12), (2, None, 1, 4)]


DIGITS = {str(i): [str(i), chr(0xFF10 + i), chr(0x0660 + i)] for i in range(10)}
NAMES = [n.split() for n in P.DIGIT_NAMES]


@st.composite
def disguised(draw):
    """(kind, disguise): a plain identifier written in one of the disguises that the module lists."""
    kind = draw(st.sampled_from(["email", "ip", "card", "spelled card"]))
    if kind == "email":
        at = draw(st.sampled_from([" (at) ", "[at]", " at ", "{at}", " _at_ ", "(@)"]))
        dot = draw(st.sampled_from([" (dot) ", "[dot]", " dot ", "[.]", " {dot} "]))
        if at == " at ":
            dot = " dot "
        return kind, f"{draw(st.sampled_from(['jane', 'j.roe', 'bob_9']))}{at}site{dot}org"
    if kind == "ip":
        parts = [str(draw(st.integers(0, 255))) for _ in range(4)]
        return kind, draw(st.sampled_from(["[.]", " dot ", "(dot)", "dot", "。"])).join(parts)
    number = "4111111111111111"
    if kind == "spelled card":
        names = draw(st.sampled_from(NAMES))
        return "card", draw(st.sampled_from([" ", "-", ", "])).join(names[int(d)] for d in number)
    return kind, "".join(draw(st.sampled_from(DIGITS[d])) for d in number[:-1]) + draw(st.sampled_from(DIGITS["1"][1:]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["The text is;", "so; ", "Ünd: ", "x; "]), disguised()), min_size=1, max_size=3))
def test_disguised_identifiers_map_back_to_their_characters(parts):
    text, want = "", []
    for before, (kind, body) in parts:
        text += before + " "
        want.append((kind, len(text), len(text) + len(body)))
        text += body + "; "
    base, added = P.find_spans(text)
    assert base == [] and added == sorted(want, key=P._order)
    red = P.redacted(text, added)
    assert all(red.count(f"[{k.upper()}]") == sum(w[0] == k for w in want) for k in P.KINDS)


def test_query_keeps_its_contract(spark):
    rows = P.op8_pii(spark, "/root/testdata/sf0.001")
    assert rows.dtypes[:7] == [("doc_id", "bigint"), ("n_email", "bigint"), ("n_ip", "bigint"), ("n_card", "bigint"), ("n_phone", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = rows.collect()
    assert len(got) == len(texts) and sum(r.n_email for r in got)
    for r in got:
        base = plain(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in P.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        listed = [x.split(":") for x in r.spans.split(",") if x]
        spans = [(k, int(a), int(b)) for k, a, b in listed]
        assert spans == sorted(spans, key=P._order) and set(base) <= set(spans) and all(b <= len(texts[r.doc_id]) for _, _, b in spans)
