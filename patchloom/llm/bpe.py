"""Op 8: encode and decode with a streaming BPE transducer of bounded lookahead.

The merge list gives a sufficient lookahead, computed once by ``lookahead``: a merge that crosses a cut can disturb
the token left of it only through a chain of merges of falling rank, so the longest such chain, in symbols, bounds how
far right of a token anything can still change it. ``Transducer.word`` therefore buffers a bounded window of symbols,
emits the tokens that end before the last ``lookahead`` symbols of it, and goes on with the rest; memory doesn't grow
with the word or the text. Words come from the vocabulary's normaliser and splitter, cut at ASCII white space, which
no word crosses. Repeated words are answered from a bounded memo. ``Decoder`` turns ids back into text byte by byte.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batch, map_batches

#: Characters whose normal form, lower case and class are the same in every Unicode version (fixed values of Unicode):
#: printable ASCII, and Latin letters with marks but for I with dot above.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]*")
#: The splitter's pattern (fixed value of the vocabulary file) over those characters once lower-cased.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[!-/:-@\[-`{-~]+")


def byte_letters() -> list[str]:
    """Which letter stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """A sufficient lookahead of a ranked merge list, in symbols.

    reach[t]: how far right of the start of token t a merge so far can have come into play that takes t as its left
    part. A merge (x, y) of a later rank is prevented by it if t starts y, which carries the reach over by x's length.
    """
    parts = {a + b: (a, b) for a, b in merges}
    size: dict[str, int] = {}

    def symbols(t: str) -> int:
        if t not in size:
            size[t] = sum(map(symbols, parts[t])) if t in parts else 1
        return size[t]

    reach: dict[str, int] = {}
    most = 1
    for x, y in merges:
        right, t = symbols(y), y
        while True:
            right = max(right, reach.get(t, 0))
            if t not in parts:
                break
            t = parts[t][0]
        far = symbols(x) + right
        reach[x] = max(reach.get(x, 0), far)
        most = max(most, far)
    return most


#: What bytes.split() splits at.
BLANK = re.compile(rb"[ \t\n\r\x0b\f]")


class Transducer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.rank = {m: i for i, m in enumerate(merges)}
        self.end = model.get("end_of_word_suffix") or ""
        self.ahead = lookahead(merges)
        self.window = max(64, 4 * self.ahead)
        self.letter = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.chunks = Memo(self.chunk, 1 << 18)
        self.words = Memo(self.word, 1 << 18)

    def split(self, symbols: list[str]) -> list[str]:
        """Merge a bounded list of symbols, least rank first and leftmost among equals."""
        rank = self.rank
        if len(symbols) < 64:
            none = 1 << 30
            ranks = [rank.get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
            while ranks and (best := min(ranks)) != none:
                i = ranks.index(best)
                merged = symbols[i] = symbols[i] + symbols.pop(i + 1)
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((symbols[i - 1], merged), none)
                if i < len(ranks):
                    ranks[i] = rank.get((merged, symbols[i + 1]), none)
            return symbols
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live: list[str | None] = list(symbols)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := self.rank.get((live[i], live[j]))) is not None:
                heapq.heappush(heap, (r, i, live[i], live[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j >= n or live[j] != b:
                continue
            live[i], live[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [t for t in live if t is not None]

    def tokens(self, word: Iterable[str]) -> Iterator[int]:
        """Ids of one word given letter by letter; a token is emitted once the lookahead right of it is known."""
        held: list[str] = []
        last = None
        for c in word:
            if last is not None:
                held.append(last)
                if len(held) >= self.window:
                    done = 0
                    for t in self.split(held):
                        size = self.symbols(t)
                        if done + size > len(held) - self.ahead:
                            break
                        done += size
                        yield from self.ids(t)
                    held = held[done:]
            last = c
        if last is not None:
            held.append(last + self.end)
            for t in self.split(held):
                yield from self.ids(t)

    def symbols(self, token: str) -> int:
        return len(token) - len(self.end) if self.end and token.endswith(self.end) else len(token)

    def ids(self, token: str) -> Iterator[int]:
        if token in self.vocab:  # a symbol outside the vocabulary is dropped, as the library does without an unknown token
            yield self.vocab[token]

    def word(self, word: bytes) -> bytes:
        if len(word) < 64:  # within the window: the end of the word is in sight
            symbols = [*map(self.letter.__getitem__, word)]
            symbols[-1] += self.end
            return b"".join([self.packed[t] for t in self.split(symbols) if t in self.packed])
        return np.fromiter(self.tokens(map(self.letter.__getitem__, word)), dtype="<u4").tobytes()

    def chunk(self, raw: bytes) -> bytes:
        """Ids of what stands between white space."""
        text = raw.decode("utf-8")
        if "<" not in text:
            return self.plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            found = [w.encode() for w in WORDS.findall(text.lower())]
        else:
            back = {c: b for b, c in enumerate(self.letter)}
            found = [bytes(map(back.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        return b"".join(map(self.words.__getitem__, found))

    def pieces(self, text: bytes, step: int = 1 << 16) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, for about ``step`` bytes of text at once, cut at white space."""
        at = 0
        while at < len(text):
            cut = BLANK.search(text, at + step) if len(text) - at > step else None
            end = cut.start() if cut else len(text)
            yield b"".join(map(self.chunks.__getitem__, text[at:end].split()))
            at = end

    def encode(self, text: bytes) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self.pieces(text))


class Decoder:
    """Incremental: ids in, text out. State: bytes of an unfinished character, and whether a token came before."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
        self.text = [""] * (1 + max(i for _, i in pairs))
        for t, i in pairs:
            self.text[i] = t
        #: Without a decoder in the vocabulary file the library joins the tokens' own spelling with spaces.
        self.spaced = [f" {t}".encode() for t in self.text]
        if spec.get("decoder") is not None:
            raise ValueError("vocabularies with a decoder of their own aren't supported")

    def pieces(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        first = True
        for part in ids:
            data = b"".join(map(self.spaced.__getitem__, part.tolist()))
            if data:
                yield state.decode(data[1:] if first else data)
                first = False
        yield state.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def vocabulary(name: str) -> str:
    """Where this machine has a vocabulary file: the name itself if it is a path, else the public tokenizers' folder."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(enc: Transducer, dec: Decoder, text: bytes, step: int = 1 << 16) -> tuple[int, str, str]:
    """Number of tokens, sha256 of the ids and of the decoded text; ids and decoded text are held a piece at a time."""
    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

    def ids() -> Iterator[np.ndarray]:
        nonlocal n
        for piece in enc.pieces(text, step):
            ids_hash.update(piece)
            n += len(piece) // 4
            yield np.frombuffer(piece, dtype="<u4")

    for part in dec.pieces(ids()):
        text_hash.update(part.encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def roundtrip(docs: DataFrame, vocab: str = "word_bpe_49k.json") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A map over rows without a shuffle. Null texts count as empty: no tokens, digests of nothing. Repeated rows and null
    doc_ids each give a row; other columns are ignored. A text of any length is encoded whole.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = transducer(vocabulary(vocab)), decoder(vocabulary(vocab))
        for b in batches:
            rows: dict[str, list] = {"doc_id": b.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in b.column("text"):
                n, ids_hash, text_hash = digests(enc, dec, text.as_py() or b"")
                rows["n_tokens"].append(n)
                rows["ids_sha256"].append(ids_hash)
                rows["decoded_sha256"].append(text_hash)
            yield batch(out, rows)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
