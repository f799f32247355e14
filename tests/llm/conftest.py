from __future__ import annotations

import pytest

from veilsift.llm.queries import found_by_workers


@pytest.fixture(autouse=True)
def workers(spark):
    found_by_workers(spark)


#: Texts at the edges of the tokenizers' rules.
ODD_TEXTS = [
    None, "", "  ", "a  b", "a \n b", "\n\n", "x  y", "   z ", "<|endoftext|>",
    "a <|endoftext|> b<|startoftext|>c", "ΣίσυφοΣ ΟΔΟΣ",
    "İstanbul ǅ é é ́x", "it's  don'T we’re we're", "1234 5.6%", "a" * 3000,
    "abc" * 400 + " x", "日本語 テキスト", "\U0001f600\U0001f600 ok",
    "\x1c!\x1f? \x85 q", "a\t\tb \t c  ", "​ 　  x", "ﬁ Å Å", "ẞ ß",
    "tab\t \nb", "end ", "end  ", "end\n ", "x\x0b \x0cy", "ŉ ῼ Ǆ", "the same", "the same",
]


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
