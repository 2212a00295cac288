"""Token ids of texts inside a task.

`ranks` may name the vocabulary of the tokenizer file in rank form, which is several times faster;
both sort characters of European scripts into the same classes and give equal ids there. Texts
with other characters, or without `ranks`, go through the tokenizer file itself.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

import numpy as np

_OTHER_SCRIPTS = re.compile("[^\0-ӿ]")
_LOADED: dict[tuple[str, str | None], TextEncoder] = {}


class TextEncoder:
    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # control strings in a text are ordinary text
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("text", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        found = []
        for text in texts:
            if self.fast and not _OTHER_SCRIPTS.search(text):
                ids = self.fast.encode_ordinary(text)
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            found.append(np.asarray(ids, "<u4"))
        return found


def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> TextEncoder:
    """The worker's encoder for these files."""
    if (path, ranks) not in _LOADED:
        _LOADED[path, ranks] = TextEncoder(path, ranks, pattern)
    return _LOADED[path, ranks]
