"""Token ids of whole texts, for use inside tasks."""

from __future__ import annotations

import functools
import json

import numpy as np

# Fixed value: the public pre-tokenizing pattern of byte-level BPE vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for:
    printable Latin-1 bytes stand for themselves, the others are numbered from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of a ``tokenizers`` byte-level BPE file as little-endian unsigned 32-bit bytes.

    Where the file is a plain byte-level BPE whose ids are its merge ranks,
    texts go through the ranks in ``tiktoken``, which takes less than half the
    time; the first text of every call is also encoded by ``tokenizers``, and
    from the first difference on, as for texts with special tokens and for any
    other file, only ``tokenizers`` is used.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.ranks = self._ranks(json.load(f))

    @staticmethod
    def _ranks(spec: dict):
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (model.get("type", "BPE") != "BPE" or spec.get("normalizer") or model.get("dropout")
                or any(pre.get(k) != v for k, v in plain.items())):
            return None
        import tiktoken
        byte = byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, those of ``Tokenizer.encode(text, add_special_tokens=False)``."""
        if self.ranks and texts:
            fast = [None if any(s in t for s in self.specials)
                    else np.asarray(self.ranks.encode_ordinary(t), "<u4").tobytes() for t in texts]
            if fast[0] in (None, self._plain(texts[0])):
                return [self._plain(t) if b is None else b for t, b in zip(texts, fast)]
            self.ranks = None
        return [self._plain(t) for t in texts]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    return Encoder(path)
