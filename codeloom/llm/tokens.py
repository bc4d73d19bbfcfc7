"""Token ids of texts by a public word-level BPE tokenizer."""

from __future__ import annotations

import array
import re
from collections.abc import Callable

from codeloom.llm.common import worker_cache

# Letters and numbers of the range below, as the tokenizer's own pattern divides them.
_LETTERS = "a-zªµºß-öø-ÿĀ-ſ"
_NUMBERS = "0-9²³¹¼½¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: Texts with other signs than these, or that may hold a special token, go through the tokenizer whole.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ]|<\\|")
#: Words kept by a Python worker.
MAX_WORDS = 300_000


def id_encoder(path: str) -> Callable[[bytes | None], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit numbers, as
    ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them.

    The tokenizer lowers a text, drops white space and never joins what white space
    divides. So words of the usual signs are encoded once and remembered (a bounded
    number of them), which costs a fraction of encoding each text as a whole.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = worker_cache(f"tokenizer {path}", lambda: Tokenizer.from_file(path))
    words = worker_cache(f"words {path}", dict)
    model = tokenizer.model
    # Byte-level alphabet: printable bytes stand for themselves, others are moved beyond 255.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def encode_word(word: str) -> bytes:
        ids = array.array("I")
        for piece in _PIECES.findall(word):
            signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(alphabet)
            ids.extend(t.id for t in model.tokenize(signs))
        if len(words) >= MAX_WORDS:
            words.clear()
        words[word] = made = ids.tobytes()
        return made

    def encode(text: bytes | None) -> bytes:
        if not text:
            return b""
        plain = text.decode("utf-8", "replace")
        if _UNUSUAL.search(plain):
            return array.array("I", tokenizer.encode(plain, add_special_tokens=False).ids).tobytes()
        parts = plain.lower().split()
        try:
            return b"".join(map(words.__getitem__, parts))
        except KeyError:
            return b"".join([words[w] if w in words else encode_word(w) for w in parts])

    return encode
