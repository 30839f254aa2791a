import hashlib
import re

import pytest

from larkspur.llm import pii
from larkspur.llm.spans import CONTEXT
from tests.llm.helpers import odd_docs, sample_docs

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def spans(text):
    return sorted((m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(m[0]))


def joined(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


HARD = [
    "a@b.c_x@d.e", "mail é😀 x.y+z@a-b.example.com.", "a@b", "@a.b x@.c", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3.256", "99999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 1",
    "+1 (437) 555-0689 +12 345 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +44 20 7946 0958.", "1" * 3000, "1 " * 3000, "a." * 3000 + "@", "x" * 5000 + "@y.z", "a@b.c@d.e@f.g", "5 55 555", "+1+1+1 555 0000000", "1.1.1.1@x.y",
]


@pytest.mark.parametrize("made", [odd_docs, sample_docs, lambda s: odd_docs(s, HARD)])
def test_base_against_brute_force(spark, made):
    docs = made(spark).repartition(2)
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, ",".join(s for s in r.spans.split(",") if not s.startswith("context"))) for r in pii.detect(docs).collect())
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        s = spans(t)
        want.append((d, *[sum(x[2] == k for x in s) for k in BASE], hashlib.sha256(joined(s).encode()).hexdigest(), joined(s)))
    assert got == sorted(want)


def taught():
    seeds = [f"please write to: user{i}@mail.example.com today" for i in range(8)]
    return seeds + ["please write to: someone@localhost today", "see section 3 of part 12345 here", "word write to: 77"]


def test_contexts_find_what_no_pattern_has(spark):
    texts = taught()
    got = {r.doc_id: r.spans for r in pii.detect(odd_docs(spark, texts)).collect()}
    at = texts[8].index("someone")
    assert got[8] == f"context:{at}:{at + len('someone@localhost')}"
    assert got[9] == "" and got[10] == ""


def outlined(x):
    return re.sub("[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", x))


def brute_contexts(texts):
    """The scoring of contexts, in plain Python."""
    tokens = []
    for d, t in enumerate(texts):
        base, before = spans(t), 0
        for m in re.finditer(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*", t):
            left = re.search(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", t[before : m.start()][-CONTEXT:].lower())
            value = re.sub(r"^[^a-z0-9@+]+|[^a-z0-9]+$", "", m[0].lower())
            tokens.append([d, m.start(), m.end(), left[1] if left else "", value, any(s < m.end() and m.start() < e for s, _, _, e in base), ""])
            before = m.end()
        own = [x for x in tokens if x[0] == d]
        for i, x in enumerate(own):
            after, upto = "", x[2]
            for k in range(i + 1, i + 3):  # the text up to the next token, and beyond it, with tokens by their outlines
                gap = t[upto : own[k][1] if k < len(own) else len(t)].lower()[:CONTEXT]
                after += gap
                if len(gap) >= CONTEXT or k >= len(own):
                    break
                after += outlined(t[own[k][1] : own[k][2]].lower())[:CONTEXT]
                upto = own[k][2]
            right = re.match(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)?)", after)
            x[6] = right[1] if right else ""
    edges = {}
    for _, _, _, left, value, seed, right in tokens:
        outline = outlined(value)
        named = [f"2 {left}", f"1 {left.split()[-1]} {outline}"] if left else []
        named += ([f"r2 {right}"] if len(right.split()) > 1 else []) + [f"r1 {right.split()[0]} {outline}"] if right else []
        for c in named if value else []:
            edges[c, value] = edges.get((c, value), False) or seed
    seeds = {v: any(s for (_, w), s in edges.items() if w == v) for _, v in edges}
    score = {v: float(s) for v, s in seeds.items()}
    for _ in range(50):
        good = {}
        for c in {c for c, _ in edges}:
            own = [score[v] for k, v in edges if k == c]
            if sum(x >= 1 for x in own) >= pii.SUPPORT and sum(own) / len(own) >= pii.CONFIDENCE:
                good[c] = sum(own) / len(own)
        new = {}
        for v in seeds:
            miss = 1.0
            for c, w in edges:
                if w == v and c in good:
                    miss *= 1 - min(good[c], 0.99)
            new[v] = 1.0 if seeds[v] else 1 - miss
        score = new
    found = {v for v in seeds if not seeds[v] and score[v] >= pii.SCORE and ("@" in v or len(re.sub("[^0-9]", "", v)) >= pii.DIGITS)}
    return sorted((d, s, e) for d, s, e, _, v, seed, _ in tokens if v in found and not seed)


def test_contexts_against_brute_force(spark):
    texts = taught() + [f"call me on {f'u{i}@x.example.com' if i % 9 else '5550' + str(i) + '999'} or later" for i in range(40)] + [r.text or "" for r in sample_docs(spark).orderBy("doc_id").limit(60).collect()]
    rows = pii.detect(odd_docs(spark, texts)).collect()
    got = sorted((r.doc_id, *map(int, s.split(":")[1:])) for r in rows for s in r.spans.split(",") if s.startswith("context"))
    assert got == brute_contexts(texts)
    assert len(got) > 1


def test_redaction_keeps_the_rest(spark):
    docs = odd_docs(spark, ["mail a@b.c, ip 1.2.3.4! é😀 +1 (437) 555-0689", None, "", "none", "x 1.1.1.1@x.y z"]).withColumnsRenamed({"words": "row"})
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert rows == {0: ("mail [EMAIL], ip [IP]! é😀 [PHONE]", 33), 1: (None, None), 2: ("", 0), 3: ("none", 4), 4: ("x [EMAIL] z", 11)}
    assert pii.redacted(docs.limit(0)).collect() == []


def test_redaction_of_long_texts(spark):
    texts = [("é" * n + " a@b.c ") * 5 + "x" * m for n in (0, 1, pii.BLOCK - 8, pii.BLOCK - 1, pii.BLOCK, 3 * pii.BLOCK) for m in (0, 1, pii.BLOCK)]
    got = [r.text for r in pii.redacted(odd_docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [t.replace("a@b.c", "[EMAIL]") for t in texts]


def test_words_after_an_identifier_are_a_context(spark):
    texts = [f"{w} +1437555068{i} is my number" for i, w in enumerate("call ring dial use try phone".split())] + ["well, 5550123 is my number", "at 12345 is it"]
    got = {r.doc_id: r.spans for r in pii.detect(odd_docs(spark, texts)).collect()}
    assert got[6] == "context:6:13" and got[7] == ""


def test_rounds_go_on_until_scores_settle(spark):
    """Each identifier that is found teaches the context of the next."""
    texts = [f"mail to: u{i}@x.example.com {'via' if i % 2 else 'by'} a{i}" for i in range(8)]
    for step in range(1, 6):
        texts += [f"k{step - 1}a k{step - 1}b {step}{i}7777 k{step}a k{step}b" if step > 1 else f"mail to: {step}{i}7777@y k{step}a k{step}b" for i in range(4)]
    rows = pii.detect(odd_docs(spark, texts)).collect()
    got = sorted((r.doc_id, *map(int, s.split(":")[1:])) for r in rows for s in r.spans.split(",") if s.startswith("context"))
    assert got == brute_contexts(texts)


def test_planted_identifiers(spark):
    """Recall and precision over badge numbers, which no base pattern has, that stand where phone numbers and mails do."""
    ways = ["reach us at {} any day", "contact: {} for help", "my private line is {} now", "send it to {} please"]
    said = [w.format(x) for i in range(40) for w in ways for x in (f"+1 437 555 {1000 + i}" if i % 2 else f"user{i}@mail.example.com",)]
    hidden = [w.format(f"BX-{70000 + 13 * i}") for i, w in enumerate(ways * 4)]
    plain = [f"in the year {1900 + i} about {10000 + 7 * i} people lived there" for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.detect(odd_docs(spark, said + hidden + plain)).collect()}
    found = {d for d, s in got.items() if "context" in s}
    wanted = set(range(len(said), len(said) + len(hidden)))
    assert len(found & wanted) >= 0.95 * len(wanted) and len(found - wanted) <= 0.05 * len(found)
