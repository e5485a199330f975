"""Token ids of whole texts with a byte-level BPE file of the ``tokenizers`` library.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
Texts go through ``tiktoken`` with the ranks read from the same file, which
takes a sixth of the time; a text that holds a special token's string, which
the file turns into that token, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
from array import array

# The byte-level pre-tokenizer's rule, written so that runs are never tried twice.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level BPE vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [t["content"] for t in described["added_tokens"]]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in self.special}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> array:
        """Ids as unsigned 32-bit numbers."""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids)
        return array("I", self.plain.encode_ordinary(text))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
