"""No operator takes square time on long texts of one kind."""

import time

import pytest

from colloquy.llm import pairs, pii, spam, splitting, tokenizer

FINDER = pii.Finder(pii.Names.learn([("Odalawen", "given"), ("Garrabach", "family")]))
LONG = {
    "letters": "y" * 200_000, "digits": "1" * 200_000 + "a", "digit words": ("12" * 30 + "a ") * 3000, "dots": "a." * 80_000, "blanks": " " * 200_000 + "x", "lines": "\n" * 200_000 + "x", "ats": "@" * 100_000,
    "tags": "<a " * 20_000, "quotes": '"' * 100_001, "capitals": "Abc " * 50_000, "fences": "```" * 30_001, "han": "字" * 100_000, "stops": ". " * 80_000, "brackets": "(" * 100_000, "titles": "Mr A. " * 30_000, "houses": "12 Ab " * 30_000,
}


@pytest.mark.parametrize("kind", LONG)
def test_long_text(kind):
    text, began = LONG[kind], time.process_time()
    FINDER.segments(text)
    pii.visible(text)
    pairs.defect("How do I do this?", text)
    pairs.defect(text, text)
    assert 0 <= spam.Judge().spam_share(text) <= 1.0001
    assert list(splitting.pieces(text, 512, 32))[-1][1] == len(text)
    if tokenizer.os.path.exists(tokenizer.FOLDER):
        tokenizer.encoder(tokenizer.rank_file()).encode(text)
    assert time.process_time() - began < 60
