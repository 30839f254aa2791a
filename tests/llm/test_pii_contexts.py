"""Identifiers whose context lies beyond another token, at a text's start, or that are written in groups."""

from larkspur.llm import pii
from tests.llm.helpers import odd_docs


def spans_of(spark, texts):
    return [r.spans for r in sorted(pii.detect(odd_docs(spark, texts)).collect(), key=lambda r: r.doc_id)]


def test_one_word_at_the_start_is_a_context(spark):
    texts = [f"Passport +1437555068{i}" for i in range(6)] + ["Passport +12345"]
    assert spans_of(spark, texts)[6] == "context:9:15"


def test_words_beyond_another_token_are_a_context(spark):
    texts = [f"room 44{i} badge {i}{i}@mail.example.com" for i in range(6)] + ["room 4411 badge 99@localhost"]
    assert spans_of(spark, texts)[6] == "context:16:28"


def test_second_of_a_list_has_a_context(spark):
    texts = [f"write to 12{i} u{i}@mail.example.com" for i in range(6)] + ["write to 129 u9@localhost"]
    assert spans_of(spark, texts)[6] == "context:13:25"


def test_digit_groups_are_one_candidate(spark):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "3000 0000 0000 04", "6011 0000 0000 0004"]
    texts = [f"account number is {c}, thanks" for c in cards] + ["account number is 123 456 789, thanks", "in all 123 456 times"]
    got = spans_of(spark, texts)
    assert got[5] == "context:18:29" and got[6] == ""
