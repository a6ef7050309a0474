"""Byte-level BPE ids as the tokenizers library gives them.

The vocabulary is read from the tokenizer's .json. Encoding goes through tiktoken, which merges the same pairs several times
faster, where the file proves that both agree; any other file is encoded by tokenizers itself. Added tokens inside texts are single
ids, as is that library's default. A long run of white space is one word but for its last character, if something else stands behind
it; such words are merged by themselves, as the regular expression that cuts texts gives up on them. Should it give up on anything
else, tokenizers encodes that text.

The proof: the plain byte-level pre-tokenizer cuts words alike. Within a word the library applies the listed merge of the least
rank; tiktoken joins whatever neighbours make the token of the least id. With one merge for each token and ids in the order of
merges, both do the same until tiktoken joins some a and b, not a listed pair, to a token t. Then no merge of less rank is left,
and as no merge crossed the ends of a or b, all merges of less rank make a and b of the bytes of t alone. But the library makes t
of its own bytes, which is checked for each token, so these merges leave the listed pair of t: a and b are that pair.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

#: Fixed value: how the byte-level pre-tokenizer cuts texts.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a word of the pre-tokenizer always ends, whatever stands around: behind letters, digits, and signs before white space.
SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=\s)")
LETTERS = regex.compile(r"\p{L}{2}")
#: Runs of white space that are encoded apart.
RUN = 1 << 14
BLANK = regex.compile(rf"\s{{{RUN},}}")
#: How tiktoken's regular expressions give up on some endless runs.
GIVES_UP = ("PanicException", "ValueError")


def _byte_of_char() -> dict[str, int]:
    """The vocabulary writes printable bytes as themselves and the rest, in order, from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def _merged(token: str, vocab: dict[str, int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """What the merges make of a token's own bytes: of all listed neighbours the pair of the least rank is joined, again and again."""
    ids = [vocab[c] for c in token]
    while len(ids) > 1:
        least, at = min((ranks.get(pair, len(vocab)), i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
        if least == len(vocab):
            break
        ids[at : at + 2] = [least]
    return ids


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library, self._fast = path, None, None
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._reach = max(map(len, added), default=0)
        if self._agrees(spec, added):
            import tiktoken

            to_byte = _byte_of_char()
            ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
            self._fast = tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens=added)
            #: Pairs of bytes that are neighbours in some token; between other bytes nothing is ever merged.
            self._joins = np.zeros((256, 256), bool)
            for token in ranks:
                self._joins[list(token[:-1]), list(token[1:])] = True

    def _agrees(self, spec: dict, added: dict[str, int]) -> bool:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            return False
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return False
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            return False
        vocab = model["vocab"]
        ranks = {(vocab[a], vocab[b]): vocab[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
        if not (np.diff(list(ranks.values())) > 0).all():  # one merge for each token, too
            return False
        return all(_merged(token, vocab, ranks) == [i] for token, i in vocab.items() if token not in added)

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_padding()
            self._library.no_truncation()
        return self._library

    def _library_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _plain(self, text: str) -> np.ndarray:
        special = self._fast.special_tokens_set if self._added and self._added.search(text) else set()
        try:
            return self._fast.encode_to_numpy(text, allowed_special=special, disallowed_special=())
        except BaseException as e:
            if type(e).__name__ not in GIVES_UP:
                raise
            return self._library_ids(text)

    def encode(self, text: str) -> np.ndarray:
        if self._fast is None:
            return self._library_ids(text)
        parts, at = [], 0
        for m in BLANK.finditer(text) if len(text) >= RUN else ():
            start, end = m.span()
            if end < len(text) and not (self._added and self._added.match(text, end)):
                end -= 1
            parts += [self._plain(text[at:start]), np.array(self._fast._encode_single_piece(text[start:end]), np.uint32)]
            at = end
        return np.concatenate([*parts, self._plain(text[at:])]) if parts else self._plain(text)

    def lengths(self, texts: list[str]) -> list[int]:
        """How many ids each text has, by one batch call; texts with added tokens or long runs are encoded one by one."""
        if self._fast is None:
            return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        plain = [not (self._added and self._added.search(t)) and not (len(t) >= RUN and BLANK.search(t)) for t in texts]
        try:
            found = map(len, self._fast.encode_ordinary_batch([t for t, ok in zip(texts, plain, strict=True) if ok], num_threads=1))
            return [next(found) if ok else len(self.encode(t)) for t, ok in zip(texts, plain, strict=True)]
        except BaseException as e:
            if type(e).__name__ not in GIVES_UP:
                raise
            return [len(self.encode(t)) for t in texts]

    def _inside_added(self, text: str, cut: int) -> bool:
        low = max(0, cut - self._reach)
        return bool(self._added) and any(m.start() < cut - low < m.end() for m in self._added.finditer(text[low : cut + self._reach]))

    def _cut(self, text: str, start: int, end: int) -> int | None:
        """The first safe boundary in a stretch of ``text``: where a word ends, else between letters that no token joins."""
        for m in SAFE.finditer(text, start, end):
            if not self._inside_added(text, m.start()):
                return m.start()
        if self._fast is not None:
            raw = np.frombuffer(text[start - 1 : end].encode("utf-8", "surrogatepass"), np.uint8)
            begins = np.flatnonzero((raw & 0xC0) != 0x80)
            apart = np.flatnonzero(~self._joins[raw[begins[1:] - 1], raw[begins[1:]]])
            for cut in (start + apart).tolist():
                if LETTERS.fullmatch(text, cut - 1, cut + 1) and not self._inside_added(text, cut):
                    return cut
        return None

    def pieces(self, text: str, chars: int) -> list[str]:
        """``text`` cut at safe boundaries, each piece of about ``chars``; the ids of the pieces, joined, are those of the text."""
        out, at = [], 0
        while len(text) - at > chars:
            cut = next((c for s in range(at + chars, len(text), chars) if (c := self._cut(text, s, min(s + chars, len(text)))) is not None), None)
            if cut is None:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def encode_long(self, text: str, chars: int) -> np.ndarray:
        if len(text) <= chars:
            return self.encode(text)
        return np.concatenate([self.encode(p) for p in self.pieces(text, chars)])


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
