"""BPE encoding and decoding with content-defined chunk reuse.

Encoding. A rolling hash over the last 16 bytes cuts every text where its low bits are zero, so equal passages are cut
alike wherever they stand. A chunk is encoded once by each worker and kept, in bounded memory, for every later document
that holds it. A cut may fall inside a word: where two chunks meet, what stands between the last white space of the left
and the first white space of the right is encoded again as one, the window growing over chunks without white space,
until both its ends are white space. There the encoding agrees exactly with that of the whole text: the tokenizer
drops white space and never joins anything over it (added tokens hold none).

Inside a chunk the same holds for each word, so words too are encoded once and kept. The tokenizer itself only sees
words it has not met lately.

Decoding joins the token strings, as the library does for a tokenizer file that names no decoder; other decoders go
through the library.

Rows are encoded where they are read: no shuffle, and a lost executor costs its partitions only. Memory is bounded by the
two caches and the longest text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BITS, LEAST_CHUNK, MOST_CHUNK = 10, 256, 8192
CHUNK_CACHE_CHARS, WORDS_KEPT, LONGEST_KEPT_WORD = 4_000_000, 250_000, 64
#: Letters that normal form C leaves alone and that lower-case one by one, then ASCII marks but the apostrophe.
LETTERS_THEN_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The public rule of byte-level tokenizers: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _gear() -> np.ndarray:
    """A pseudo-random number for each byte value, by rule (the finaliser of a linear congruence)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of UTF-8 ``data``; never inside a character."""
    if len(data) <= LEAST_CHUNK:
        return [len(data)] if data else []
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for width in (1, 2, 4, 8):  # the hash of the last 16 bytes, by doubling
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    starts = (raw & 0xC0) != 0x80
    possible = np.flatnonzero((h[:-1] >> np.uint32(32 - CHUNK_BITS) == 0) & starts[1:]) + 1
    out, last = [], 0
    for at in [*possible.tolist(), len(data)]:
        while at - last > MOST_CHUNK:
            forced = last + MOST_CHUNK
            while not starts[forced]:
                forced -= 1
            out.append(forced)
            last = forced
        if at - last >= LEAST_CHUNK or at == len(data) and at > last:
            out.append(at)
            last = at
    return out


class ChunkEncoder:
    """Encodes whole texts exactly as the tokenizer of ``tokenizer_path`` does, through the caches."""

    def __init__(self, tokenizer_path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(tokenizer_path, encoding="utf-8") as f:
            self.plain_decoder = json.load(f).get("decoder") is None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.strings = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.model = self.tokenizer.model
        self.splits = self._splits_letters_from_marks()
        self.words: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.chunks: dict[str, tuple] = {}
        self.chunk_chars = 0
        self.encoded_chunks = self.reused_chunks = 0

    def _splits_letters_from_marks(self) -> bool:
        """Whether this tokenizer lower-cases and takes letters and the marks after them apart, as a probe shows."""
        ids = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        probe = "Wörtchen"
        inner = [t.id for t in self.model.tokenize("".join([BYTE_CHARS[c] for c in probe.lower().encode()]))]
        return ids(f"{probe}!?_") == inner + ids("!?_") and ids(probe) == inner

    def _keep(self, word: str, found: tuple[int, str, str]) -> tuple[int, str, str]:
        if len(word) <= LONGEST_KEPT_WORD:
            if len(self.words) >= WORDS_KEPT:
                self.older = self.words.copy()
                self.words.clear()  # the same object, as a run in progress looks in it
            self.words[word] = found
        return found

    def _word(self, word: str) -> tuple[int, str, str]:
        """The encoding of a word that holds no ASCII white space and is not among the newer words."""
        found = self.older.get(word)
        if found is None:
            ids = None
            if self.splits and (m := LETTERS_THEN_MARKS.fullmatch(word)):
                stem = m[1].lower()
                if stem != word:
                    x = self.words.get(stem) or self._word(stem)
                    if not m[2]:
                        return self._keep(word, x)
                    y = self.words.get(m[2]) or self._word(m[2])
                    return self._keep(word, (x[0] + y[0], f"{x[1]} {y[1]}", f"{x[2]} {y[2]}"))
                if len(stem) <= LONGEST_KEPT_WORD:
                    ids = [t.id for t in self.model.tokenize(stem if stem.isascii() else "".join([BYTE_CHARS[c] for c in stem.encode()]))]
            if ids is None:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = (len(ids), " ".join(map(str, ids)), " ".join([self.strings[i] for i in ids]))
        return self._keep(word, found)

    def _run(self, text: str) -> tuple[int, str, str]:
        """(tokens, ids, token strings) of a text that stands between white space."""
        for c in "\n\t\r":
            if c in text:
                text = text.replace(c, " ")
        known, missed = self.words.get, self._word
        found = [known(w) or missed(w) for w in text.split(" ") if w]
        ids = [x[1] for x in found]
        strings = [x[2] for x in found]
        if "" in ids:  # words of no token
            ids, strings = [x for x in ids if x], [x for x in strings if x]
        return sum([x[0] for x in found]), " ".join(ids), " ".join(strings)

    def _chunk(self, text: str) -> tuple:
        """(left fragment, encoding of the middle, right fragment); without white space (text, None, text)."""
        found = self.chunks.get(text)
        if found is None:
            self.encoded_chunks += 1
            first = min((at for c in " \n\t\r" if (at := text.find(c)) >= 0), default=-1)
            last = max(text.rfind(c) for c in " \n\t\r")
            found = (text, None, text) if first < 0 else (text[:first], self._run(text[first : last + 1]), text[last + 1 :])
            if self.chunk_chars > CHUNK_CACHE_CHARS:
                self.chunks.clear()
                self.chunk_chars = 0
            self.chunks[text] = found
            self.chunk_chars += 4 * len(text)
        else:
            self.reused_chunks += 1
        return found

    def encode(self, text: str) -> tuple[int, str, str]:
        """(tokens, decimal ids joined by a space, token strings joined by a space) of a whole text."""
        data = text.encode("utf-8")
        parts, window, at = [], [], 0
        for end in cuts(data):
            left, middle, right = self._chunk(data[at:end].decode("utf-8"))
            at = end
            window.append(left)
            if middle is None:
                continue  # no white space yet: the window grows
            parts.append(self._run("".join(window)))  # the join, encoded again as one
            parts.append(middle)
            window = [right]
        parts.append(self._run("".join(window)))
        parts = [p for p in parts if p[0]]
        return sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def decode(self, ids: list[int], strings: str | None = None) -> str:
        """The library's decode(ids, skip_special_tokens=False); ``strings``: the joined token strings, if at hand."""
        if self.plain_decoder:
            return " ".join([self.strings[i] for i in ids]) if strings is None else strings
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """``id_col``, ``ids`` (array of int), ``decoded`` and the count and digests of both, a row for each row of ``docs``.

    Null texts count as empty; empty texts have no token. Null ids and repeated rows are kept as they are; other columns
    are ignored. No rows: no rows. ``digests_only`` leaves ``ids`` and ``decoded`` out and saves moving them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                counts, id_digests, decoded_digests, all_ids, decoded = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    n, ids, strings = encoder.encode(text or "")
                    numbers = [] if digests_only and encoder.plain_decoder else [int(x) for x in ids.split()]
                    plain = encoder.decode(numbers, strings)
                    counts.append(n)
                    id_digests.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded_digests.append(hashlib.sha256(plain.encode("utf-8")).hexdigest())
                    if not digests_only:
                        all_ids.append(numbers)
                        decoded.append(plain)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(decoded_digests, pa.string())]
                names = ["doc", "n_tokens", "ids_sha256", "decoded_sha256"]
                if not digests_only:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>, decoded string")
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema).withColumnRenamed("doc", id_col)
