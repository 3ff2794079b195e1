import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from bindery.llm.pii import BASE_KINDS, anchors, find_pii, find_spans, luhn, mask, mask_pii

from .cases import no_documents, odd_documents, odd_rows

AUTOMATON = anchors()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sound(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text):
    return {k: [m.span() for m in re.finditer(p, text) if sound(k, m.group())] for k, p in PATTERNS.items()}


PIECES = st.sampled_from([
    "@", ".", "+", "-", " ", "(", ")", "1", "23", "255", "256", "007", "a", "b.c", "x@y.z", "%", "é", "4111111111111111",
    "+1 (555) 010-9999", "10.0.0.1", "://", "http", "token", "=", '"', "IBAN ", "DE89370400440532013000", "١",
])


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_base_kinds_are_the_patterns(pieces):
    text = "".join(pieces)
    found = find_spans(text, AUTOMATON)
    assert {k: found[k] for k in BASE_KINDS} == base_spans(text)


def test_added_kinds():
    text = ('see https://u:p@example.org/x?y=1, IBAN: DE89 3704 0044 0532 0130 00. Account no. 12345678; '
            'api_key = "abcdEFGH1234" ssh://h javascript://no')
    found = find_spans(text, AUTOMATON)
    named = {k: [text[s:e] for s, e in v] for k, v in found.items() if v and k not in BASE_KINDS}
    assert named["url"] == ["https://u:p@example.org/x?y=1", "ssh://h"]
    assert named["iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert named["account"] == ["12345678"] and named["secret"] == ["abcdEFGH1234"]


def test_masking_joins_overlaps():
    text = "mail a@b.co or +1 (555) 010-9999 now"
    assert mask(text, find_spans(text, AUTOMATON)) == "mail [EMAIL] or [PHONE] now"
    text = "token = 4111111111111111 x"
    assert mask(text, find_spans(text, AUTOMATON)) in ("token = [CARD] x", "token = [SECRET] x")


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "://" * 70_000, "token=" * 40_000):
        find_spans(text, AUTOMATON)


def test_odd_rows(spark):
    got = sorted(map(str, find_pii(odd_documents(spark)).collect()))
    assert len(got) == len(odd_rows())
    rows = find_pii(odd_documents(spark)).where("doc_id = 1").collect()
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[0]["spans"] == ""
    masked = mask_pii(odd_documents(spark))
    others = [c for c in masked.columns if c not in ("text", "n_chars")]
    assert masked.columns == odd_documents(spark).columns
    assert masked.select(others).exceptAll(odd_documents(spark).select(others)).isEmpty()
    two = mask_pii(spark.createDataFrame([("write to a@b.org", 1), (None, 2)], "text string, id int")).collect()
    assert [tuple(r) for r in two] == [("write to [EMAIL]", 1), (None, 2)]
    assert masked.count() == len(odd_rows()) and masked.where("text is null").count() == 2
    assert find_pii(no_documents(spark)).collect() == mask_pii(no_documents(spark)).collect() == []
