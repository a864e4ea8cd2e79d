"""Token ids of a public byte-level BPE file, as the ``tokenizers`` library gives them."""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

# Characters outside these blocks take the slower library: the two engines could know different
# Unicode versions of what is a letter or a number.
UNUSUAL = re.compile("[^\\x00-\\u036f\\u0391-\\u03a1\\u03a3-\\u0481\\u1e00-\\u1eff\\u2000-\\u205e\\u3041-\\u3096\\u4e00-\\u9fa5]")


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = set(chain(range(33, 127), range(161, 173), range(174, 256)))
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encodes texts as the library does by default: strings of special tokens become their ids.

    A byte-level file whose ids follow its merges is run by ``tiktoken``, which gives the same
    ids several times faster; anything else, and texts with unusual characters or with strings
    of added tokens, by ``tokenizers``.
    """

    def __init__(self, path: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end = [] if end_id is None else [end_id]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._fast(spec)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.slow = re.compile("|".join([UNUSUAL.pattern, *added]))

    @staticmethod
    def _fast(spec: dict):
        import public_tokenizers
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec.get("normalizer") or model.get("type") != "BPE" or model.get("dropout"):
            return None
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        vocabulary = model["vocab"]
        if any(vocabulary.get(m) != 256 + k for k, m in enumerate(merged)):
            return None
        as_byte = byte_characters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(as_byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        return tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def __call__(self, text: str) -> np.ndarray:
        """Ids of the whole text and the end id, as uint32."""
        if self.fast is None or self.slow.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids + self.end, dtype=np.uint32)


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` ids; of an overlong one the first may be shorter."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return list(zip(starts, np.diff([*starts, n]).tolist()))
