"""BPE encoding by per-prefix dynamic programming, and decoding.

The encoding of every prefix of a word has one last token.  An automaton
over the vocabulary reports all tokens that end at each position; a token is
the prefix's last one exactly if it may follow the last token of the prefix
before it, that is if the merges, run on the two tokens' symbols, end in
just these two.  That pair test is remembered, so a word costs a few table
look-ups per position; following the back-pointers from the end gives the
ids.

Text handling follows the tokenizer file: strings of the added tokens are
cut out first; the rest is normalised, split into pieces and mapped to byte
letters by the file's own text rules.  No piece spans white space, so a
white-space separated chunk always encodes alike; each worker remembers the
short chunks and pieces it has met, up to fixed numbers of bytes, and the
pairs, up to a fixed number.  Text without white space is one long chunk,
encoded whole and not remembered.  Decoding goes from the ids alone.

The vocabulary file's size is fixed; it is read once on the driver and
broadcast.

Defined results: null text is empty, and so are its ids; a very long text
is encoded whole, with memory in proportion to its longest chunk; an empty
table gives an empty result; rows are independent, so repeated rows and ids do
no harm; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.text import slices

CHUNK_BYTES, PIECE_BYTES = 32 << 20, 48 << 20          # what a worker remembers, per generation
PAIRS = 600_000
LONGEST = 64                                           # characters; longer chunks and pieces seldom come again
ENTRY_BYTES = 200                                      # a dictionary entry with a short string and its value
_SPACES = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Chunks of these letters need no general normaliser: printable ASCII and the letters of Latin-1.
_SIMPLE = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_SIMPLE_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
MARK = "\x00"              # no byte letter is U+0000


class Memory:
    """Short strings and their ids, in two generations: when the young one is full, it becomes the old one."""

    def __init__(self, limit: int):
        self.limit, self.bytes, self.young, self.old = limit, 0, {}, {}

    def recall(self, key: str):
        """From the old generation, for keys the young one lacks."""
        known = self.old.get(key)
        if known is not None:
            self.store(key, known)
        return known

    def store(self, key: str, value) -> None:
        if len(key) > LONGEST:
            return
        self.bytes += ENTRY_BYTES + 4 * len(key) + 8 * len(value)
        if self.bytes > self.limit:
            self.old, self.young, self.bytes = self.young, {}, 0
        self.young[key] = value


class Bpe:
    """Encoder and decoder of one tokenizer file (byte-level BPE with a word-end suffix)."""

    def __init__(self, text: str):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.loads(text)
        self.check(spec)
        rules = Tokenizer.from_str(text)       # its text rules only; the merging below is our own
        self.normalize, self.pieces_of = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.added.items()})
        self.name_of = self.names.__getitem__
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) \
            if self.added else None
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): k for k, m in enumerate(model["merges"])}
        # the automaton sees a word as its byte letters and one mark for the suffix
        self.auto = ahocorasick.Automaton()
        for token, i in self.ids.items():
            shown = token[:-len(self.end)] + MARK if token.endswith(self.end) else token
            self.auto.add_word(shown, (len(shown), i))
        self.auto.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.known_pieces, self.known_chunks = Memory(PIECE_BYTES), Memory(CHUNK_BYTES)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.quick = split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.letters = {b: p for b in range(256) for p, _ in self.pieces_of(chr(b)) if b < 128 and len(p) == 1}
        self.letters |= {0x80 + k: self.pieces_of(chr(0xC0 + k))[0][0][1] for k in range(64)}
        self.letters[0xC3] = self.pieces_of("\xe9")[0][0][0]

    @staticmethod
    def check(spec: dict) -> None:
        """Refuse files whose steps this class does not know."""
        model, norm = spec["model"], spec["normalizer"] or {}
        kinds = [n["type"] for n in norm.get("normalizers", [])]
        pre = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if (model["type"], kinds, pre) != ("BPE", ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) \
                or spec["decoder"] is not None or not model["end_of_word_suffix"] or model.get("byte_fallback"):
            raise ValueError("this tokenizer file has steps that are not supported")

    def symbols(self, token: str) -> tuple[str, ...]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return (*body[:-1], body[-1] + self.end)
        return tuple(token)

    def merged(self, symbols: tuple[str, ...]) -> list[str]:
        """Apply the merges by rank, leftmost first; only for the short runs of the pair test."""
        parts = list(symbols)
        while len(parts) > 1:
            k, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if k == 1 << 60:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def whole(self, i: int) -> bool:
        """Whether token ``i`` is what its own symbols merge to."""
        if i not in self.alone:
            self.alone[i] = self.merged(self.symbols(self.names[i])) == [self.names[i]]
        return self.alone[i]

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges keep ``a`` and ``b`` apart, side by side."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        first, second = self.names[a], self.names[b]
        ok = self.pairs[a << 32 | b] = self.merged(self.symbols(first) + self.symbols(second)) == [first, second]
        return ok

    def word(self, piece: str) -> list[int]:
        """Ids of one piece, given in byte letters: the last token of every prefix, then the back-pointers."""
        shown = piece + MARK
        n = len(shown)
        last, size, pairs = [-1] * (n + 1), [0] * (n + 1), self.pairs
        for end, (length, i) in self.auto.iter(shown):
            if last[end + 1] >= 0:             # a prefix has one last token only
                continue
            start = end + 1 - length
            if start == 0:
                ok = self.whole(i)
            else:
                before = last[start]
                if before < 0:
                    continue
                ok = pairs.get(before << 32 | i)
                if ok is None:
                    ok = self.follows(before, i)
            if ok:
                last[end + 1], size[end + 1] = i, length
        out, at = [], n
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"no encoding for {piece!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def chunk(self, chunk: str) -> bytes:
        """Ids, as bytes, of a run without white space."""
        known = self.known_chunks.recall(chunk)
        if known is not None:
            return known
        ids: list[int] = []
        for piece in self.pieces(chunk):
            found = self.known_pieces.young.get(piece) or self.known_pieces.recall(piece)
            if found is None:
                found = self.word(piece)
                self.known_pieces.store(piece, found)
            ids += found
        out = array("I", ids).tobytes()
        self.known_chunks.store(chunk, out)
        return out

    def pieces(self, chunk: str) -> list[str]:
        """The chunk's pieces in byte letters."""
        if self.quick and _SIMPLE.fullmatch(chunk):
            low = chunk.lower()
            if not low.isascii():
                return [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
                        for p in _SIMPLE_PIECES.findall(low)]
            return _SIMPLE_PIECES.findall(low)
        return [p for p, _ in self.pieces_of(self.normalize(chunk))]

    def split(self, text: str) -> list[str]:
        """Chunks between white space; str.split() alone would also cut at U+001C to U+001F."""
        return text.split() if not _SEPARATORS.search(text) \
            else [x for x in _SPACES.split(text) if x]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.special is not None and "<" in text and (m := self.special.search(text)):
            parts, at = [], 0
            while m:
                parts += [self.plain(text[at:m.start()]), array("I", [self.added[m[0]]]).tobytes()]
                at = m.end()
                m = self.special.search(text, at)
            parts.append(self.plain(text[at:]))
            return b"".join(parts)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        known, chunk = self.known_chunks.young.get, self.chunk
        return b"".join([known(c) or chunk(c) for c in self.split(text)])

    def decode(self, ids) -> str:
        """Without a decoder step in the file, tokens are joined by blanks; unknown ids are passed over."""
        try:
            return " ".join(map(self.name_of, ids))
        except KeyError:
            return " ".join([self.names[i] for i in ids if i in self.names])


_BUILT: dict[str, Bpe] = {}


def coder(spec: str) -> Bpe:
    """The coder of a tokenizer file's text, built once per worker process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = Bpe(spec)
    return _BUILT[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           digests: bool = False) -> DataFrame:
    """One row per document: ``id, n_tokens, ids`` (little-endian unsigned 32-bit), ``decoded``.

    ``path`` is a tokenizer file the driver can read.  With ``digests`` the
    last two are replaced by their SHA-256 as hex, taken where the text lies.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind, last = (pa.string(), ("ids_sha256", "decoded_sha256")) if digests else (pa.binary(), ("ids", "decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(spec.value)
        for whole in batches:
            for b in slices(iter([whole]), "text"):
                n, ids, decoded = [], [], []
                for t in b.column(1).to_pylist():
                    i = bpe.encode(t or "")
                    d = bpe.decode(array("I", i))
                    n.append(len(i) // 4)
                    ids.append(hashlib.sha256(i).hexdigest() if digests else i)
                    decoded.append(hashlib.sha256(d.encode()).hexdigest() if digests else d)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, pa.string())],
                    ["id", "n_tokens", *last])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id bigint, n_tokens bigint, {last[0]} {'string' if digests else 'binary'}, "
                                f"{last[1]} string")
