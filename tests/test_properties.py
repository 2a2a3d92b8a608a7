"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.functions.similarity import block_ratio_of, pair_cosine_of
from tidewire.operators.chunking import pack_sentences, split_recursively
from tidewire.sources.readers import html_fields_of

TEXT = st.text(alphabet="ab .\n!é", max_size=300)


@given(TEXT, st.integers(5, 60))
@settings(deadline=None)
def test_recursive_pieces_are_parts_of_the_text(text, size):
    pieces = split_recursively(text, size, size // 4)
    assert all(0 < len(p) <= size and p in text for p in pieces)
    assert set("".join(text.split())) == set("".join("".join(pieces).split()))


@given(TEXT, st.integers(10, 80))
@settings(deadline=None)
def test_packed_sentences_keep_all_words(text, size):
    packed = pack_sentences(text, size, 10)
    assert set(text.split()) == set(" ".join(packed).split())


@given(st.lists(st.sampled_from("abcd"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=8))
def test_pair_cosine(a, b):
    s = pair_cosine_of(a, b)
    assert -1e-9 <= s <= 1 + 1e-9 and abs(s - pair_cosine_of(b, a)) < 1e-9
    if a:
        assert abs(pair_cosine_of(a, a) - 1) < 1e-9


@given(TEXT)
def test_ratio_of_itself(text):
    assert block_ratio_of(text, text) == 1.0


@given(st.text(alphabet="<>/abp script!-&;\"'=", max_size=120))
@settings(deadline=None)
def test_html_never_raises(html):
    text, title, description = html_fields_of(html)
    assert text == " ".join(text.split())
