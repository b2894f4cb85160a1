"""Ids by the tokenizers library, for ops 1 and 9: whole texts, one call of the library for a batch's new chunks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import PLAIN, WORDS, vocabulary

#: Bytes of text encoded at once; longer texts go in parts, cut at white space.
PART = 8 << 20


class LibraryEncoder:
    """White-space chunks are encoded by the library once and remembered in a bounded memo.

    A batch's texts are split and their distinct chunks numbered by Arrow, so that only distinct chunks are looked up;
    the texts' ids are then gathered by number. Only for vocabularies whose words never cross ASCII white space and
    leave none of it in the ids (``word_bpe_49k``).
    """

    def __init__(self, path: str, size: int = 1 << 19, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # words are split and lower-cased already when they come here
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        tokens = self.library.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(1 + max(tokens.values()), dtype=bool)
        self.is_end[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        #: Two generations of at most ``size`` chunks each; the older is dropped whole.
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size, self.longest = size, longest

    def one(self, chunk: bytes) -> bytes:
        return np.array(self.library.encode(chunk.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks: those of plain characters many at a time, others one by one."""
        text = pa.array(chunks, pa.binary()).cast(pa.string())
        plain = pc.and_(pc.match_substring_regex(text, f"^(?:{PLAIN.pattern})$"), pc.invert(pc.match_substring(text, "<")))
        out: list = [None] * len(chunks)
        easy = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        # a space after each word of a chunk, so that spaces count its words
        spaced = pc.replace_substring_regex(pc.utf8_lower(text.filter(plain)), f"({WORDS.pattern})", r"\1 ")
        counts = pc.count_substring(spaced, " ").to_numpy()
        words = spaced.to_numpy(zero_copy_only=False).tolist()
        cuts = [*range(0, len(words), 256), len(words)]
        for a, z, e in zip(cuts, cuts[1:], self.bare.encode_batch_fast(["".join(words[a : a + 256]) for a in cuts[:-1]], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            word_ends = np.concatenate([[0], 4 * np.flatnonzero(self.is_end[ids]) + 4])
            last = np.cumsum(counts[a:z])
            if last[-1] != len(word_ends) - 1:
                raise ValueError("a word has no token that ends it")
            ends, data = word_ends[last].tolist(), ids.tobytes()
            for k, s, t in zip(easy[a:z].tolist(), [0, *ends], ends):
                out[k] = data[s:t]
        return [self.one(c) if x is None else x for c, x in zip(chunks, out, strict=True)]

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Each distinct chunk's ids, from the memo or learned."""
        if len(self.memo) >= self.size:
            self.memo, self.old = {}, self.memo
        values = [*map(self.memo.get, chunks)]
        missing = [k for k, v in enumerate(values) if v is None]
        new = []
        for k in missing:
            values[k] = self.old.get(chunks[k])
            if values[k] is None:
                new.append(k)
        for at in range(0, len(new), 1 << 16):
            some = new[at : at + (1 << 16)]
            for k, v in zip(some, self.learn([chunks[k] for k in some]), strict=True):
                values[k] = v
        for k in missing:
            if len(chunks[k]) <= self.longest and len(self.memo) < self.size:
                self.memo[chunks[k]] = values[k]
        return values

    def encode_part(self, texts: list[bytes]) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        values = self.ids_of(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(values), dtype="<u4")
        lengths = np.fromiter(map(len, values), dtype="i8", count=len(values)) // 4
        codes = coded.indices.to_numpy()
        n = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(lengths) - lengths)[codes] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = (4 * ends[split.offsets.to_numpy()]).tolist()
        return (ids[a:z] for a, z in zip(at, at[1:]))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        held: list[bytes] = []
        size = 0
        for t in texts:
            if held and size + len(t) > PART:
                yield from self.encode_part(held)
                held, size = [], 0
            if len(t) <= PART:
                held.append(t)
                size += len(t)
            else:
                yield b"".join(ids for part in parts(t) for ids in self.encode_part([part]))
        if held:
            yield from self.encode_part(held)


def parts(text: bytes, size: int = PART) -> Iterator[bytes]:
    """A text in parts of about that many bytes, cut before ASCII white space."""
    at = 0
    while at < len(text):
        z = at + size
        if z < len(text):
            spaces = [k for k in (text.rfind(c, at + 1, z) for c in b" \t\n\r\v\f") if k >= 0]
            while not spaces and z < len(text) and text[z] not in b" \t\n\r\v\f":
                z += 1
            z = max(spaces, default=z)
        yield text[at:z]
        at = z


@lru_cache(maxsize=2)
def library(name: str) -> LibraryEncoder:
    return LibraryEncoder(vocabulary(name))
