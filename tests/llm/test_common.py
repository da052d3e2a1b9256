import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestar.llm.common import MISREAD, fold_letters, fold_word, words

LETTERS = st.text(alphabet="abcdefghilmnorstuvw", max_size=6)


@pytest.mark.parametrize("read, printed", MISREAD)
@given(before=LETTERS, after=LETTERS)
def test_misreadings_have_one_key(read, printed, before, after):
    assert fold_letters(before + read + after) == fold_letters(before + printed + after)


def test_words():
    assert words("The ﬁling's $1,100 — c|ient") == ["the", "filing", "1", "100", "c|ient"]
    assert fold_word("1985") == "1985" and fold_word("1imited") == fold_word("limited")
