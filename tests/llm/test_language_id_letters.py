"""Numbers written as signs are no letters."""

from treeledger.llm.language_id import words_of


def test_words_hold_a_letter():
    assert words_of("²³½ ①② Ⅷ 12 _ 5") == []
    assert words_of("Haus² x½ Ünder ①") == ["haus²", "x½", "ünder"]
