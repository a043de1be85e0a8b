"""Word-wise tokenising for tokenizers that drop white space: what a worker has encoded once it looks up afterwards.

For such a tokenizer (its splitter removes white space, and nothing before it reaches across white space) the tokens
of a text are those of its white-space-separated words, one after another. The words themselves go to the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import regex

from .common import ASCII_SPACE, held

#: Words that can be split and put in lower case before the library sees them; no special token fits in.
LATIN = re.compile(r"[!-;=-{}~\xa1-\u012f\u0131-\u024f]+").fullmatch
#: What a cache entry takes besides its word and ids, and the bytes after which a worker forgets its words and starts anew.
ENTRY_BYTES, CACHE_BYTES = 150, 224 << 20


def drops_space(definition: bytes) -> bool:
    """Whether a tokenizers file has the form for which words can be encoded one by one."""
    d = json.loads(definition)
    steps = lambda x, kind: [y for y in (x or {}).get(kind, [x] if x else []) if y]
    split = steps(d.get("pre_tokenizer"), "pretokenizers")
    known = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " ") for n in steps(d.get("normalizer"), "normalizers"))
    first = split and split[0]
    removed = bool(first) and first["type"] == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not ASCII_SPACE.search(t["content"]) for t in d.get("added_tokens", []))
    return bool(known and removed and plain and not d.get("truncation") and not d.get("padding"))


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """The ranks by which tiktoken merges a part and a zero byte behind it as the model merges a part and its word end.

    A zero byte joins the byte before it first, as the ids of word ends come before those of all merges; ids rise in the
    order of merges. None for a model of another form.
    """
    suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
    if model.get("type") != "BPE" or not suffix or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    as_bytes = lambda token: bytes(byte_of[c] for c in token.removesuffix(suffix)) + (b"\0" if token.endswith(suffix) else b"")
    ranks = {as_bytes(t): i for t, i in vocab.items() if all(c in byte_of for c in t.removesuffix(suffix))}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    first = 2 * 256
    known = len(ranks) == len(vocab) == first + len(merges) and all(vocab.get(t) == first + i for i, t in enumerate(merges))
    return ranks if known and all(ranks[bytes([b])] < 256 for b in range(256)) else None


class WordTokenizer:
    """``ids(text)`` as the library gives them with add_special_tokens=False; a bounded cache by word where that is exact."""

    #: Parts that are encoded in one string.
    JOINED = 8192

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_word = drops_space(definition)
        self.merger = None
        if self.by_word:
            d = json.loads(definition)
            self.parts = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
            ranks = byte_ranks(d["model"])
            if ranks:
                self.merger = tiktoken.Encoding("parts", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
                self.ends = np.zeros(len(ranks), bool)
                self.ends[[i for token, i in ranks.items() if token.endswith(b"\0") and len(token) > 1]] = True
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: list[str]) -> list[bytes]:
        """Latin words: the pattern parts them, the merger encodes many parts at once, word ends part the ids again."""
        out, at = [], 0
        while at < len(words):
            parts, upto = [], []
            while at < len(words) and len(parts) < self.JOINED:
                low = words[at].lower()
                if low.isalpha():
                    parts.append(low)
                else:
                    parts += self.parts(low)
                upto.append(len(parts))
                at += 1
            ids = self.merger.encode_to_numpy("\0".join(parts) + "\0") if parts else np.zeros(0, "<u4")
            stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[upto] * 4
            data = ids.astype("<u4").tobytes()
            out += [data[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]
        return out

    def _learn(self, words: list[str]) -> None:
        latin = [w for w in words if LATIN(w)] if self.merger else []
        others = words if not latin else [w for w in words if not LATIN(w)] if len(latin) < len(words) else []
        for some, encode in ((latin, self._merged), (others, self._whole)):
            if some:
                ids = encode(some)
                self.known.update(zip(some, ids, strict=True))
                self.known_bytes += ENTRY_BYTES * len(some) + sum(map(len, some)) + sum(map(len, ids))

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._whole(texts)
        if self.known_bytes > CACHE_BYTES:
            self.known, self.known_bytes = {}, 0
        split = [[w for w in ASCII_SPACE.split(t) if w] if _odd_space(t) else t.split() for t in texts]
        missing = set().union(*split).difference(self.known)
        if missing:
            self._learn(list(missing))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _odd_space(text: str) -> bool:
    """Characters at which str.split() parts words and the library doesn't; at all other white space both do."""
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


def loaded(key: str, shared) -> WordTokenizer:
    """A worker's tokenizer."""
    return held(f"words {key}", lambda: WordTokenizer(shared.value))


def read_definition(path: str) -> tuple[bytes, str]:
    """A tokenizer's file, which doesn't grow with the data, and its digest, which stands for its version."""
    with open(path, "rb") as f:
        data = f.read()
    return data, hashlib.sha256(data).hexdigest()
