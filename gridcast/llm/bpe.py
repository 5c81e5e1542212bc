"""BPE encoding and decoding by dynamic programming over prefixes.

A prefix of a word has exactly one BPE encoding, so its *last token* is all
that must be stored.  An automaton over the vocabulary reads the word once
and its suffix links list the tokens that end at each position.  Such a token
is the prefix's last one if the prefix before it ends in a token compatible
with it: undoing the latest merge next to the seam, step by step, no merge
across the seam may come before the one undone.  Back-pointers from the end
give the exact ids, without running merges over the text.  The cost is linear
in the word's length.

Before that, text is split at added tokens, normalised (NFC, lower case) and
cut into pieces as the vocabulary file demands; pieces never span white space,
so each word of a text is encoded once per worker and remembered.  Words with
characters that Python's Unicode tables do not know are normalised and cut by
the file's own rules, whose tables may be newer.

Decoding joins the tokens' strings by single spaces (the file names no
decoder), added tokens included.

Defined results: null or empty text gives no ids and decodes to the empty
text; repeated rows give repeated results; null ids pass through; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts_of

#: Entries of the per-worker memories of words and of tested pairs.
CACHE_ENTRIES = 500_000

# The piece pattern of the vocabulary file, and white space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _SPACE + r"\p{L}\p{N}]+"

_FIRST_UNKNOWN = "\u0378"  # every code point below is assigned
_END = "</w>"
_MARK = "\n"  # stands for the end of a word inside the automaton

_CODECS: dict[str, "PrefixBPE"] = {}


def known_characters() -> bytes:
    """By code point, whether Python's Unicode tables assign it."""
    return bytes(unicodedata.category(chr(c)) != "Cn" for c in range(0x110000))


def byte_alphabet() -> list[str]:
    """The printable character of each byte: printable Latin-1 bytes stand
    for themselves, the others follow from 256 on in order."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, nxt = [], 256
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(nxt))
            nxt += 1
    return out


class PrefixBPE:
    """Encoder of one vocabulary file (BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        import tokenizers
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        if model["end_of_word_suffix"] != _END:
            raise ValueError("a vocabulary with word ends is expected")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.string = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.pieces = regex.compile(_PIECES, regex.V0)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.known = known_characters()
        own = tokenizers.Tokenizer.from_file(path)
        self.normalizer, self.cutter = own.normalizer, own.pre_tokenizer
        self.bytes = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(self.bytes)}
        self.merge: dict[tuple[int, int], int] = {}   # pair -> rank
        self.parts: dict[int, tuple[int, int]] = {}   # merged token -> its pair
        self.rank: dict[int, int] = {}                # merged token -> rank
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = r
            if z not in self.parts:
                self.parts[z], self.rank[z] = (x, y), r
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            key = t[:-len(_END)] + _MARK if t.endswith(_END) and len(t) > len(_END) else t
            # symbols: characters, the last together with the mark of the end
            if i in self.parts or len(key.rstrip(_MARK)) == 1:
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Does BPE leave the seam between tokens ``a`` and ``b`` alone?"""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y = a, b
        rank, parts, merge = self.rank, self.parts, self.merge
        never = len(merge) + 1
        limit = never  # the seam's pair must not merge at a rank below this
        while True:
            r = merge.get((x, y), never)
            if r < limit:
                ok = False
                break
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                ok = True
                break
            if rx > ry:              # x was formed later: undo it
                limit, x = rx, parts[x][1]
            else:                    # y was formed later, or the same merge further right
                limit, y = ry + 1, parts[y][0]
        if len(self.pairs) >= CACHE_ENTRIES:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def word(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece (already in the byte alphabet)."""
        text = piece + _MARK
        n = len(text)
        last = [0] * (n + 1)   # token that ends the prefix, by prefix length
        size = [0] * (n + 1)   # its length; 0: no token ends here
        compatible = self.compatible
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if size[end]:
                continue
            start = end - length
            if start == 0 or size[start] and compatible(last[start], token):
                last[end], size[end] = token, length
        out, at = [], n
        while at:
            if not size[at]:
                raise ValueError(f"no encoding of {piece!r}")
            out.append(last[at])
            at -= size[at]
        return tuple(out[::-1])

    def chunk(self, text: str) -> tuple[int, str, str]:
        """Count, ids and strings of a text without added tokens."""
        if text.isascii() or max(text) < _FIRST_UNKNOWN or all(self.known[ord(c)] for c in text):
            norm = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # sigma: no final form
            pieces = self.pieces.findall(norm)
        else:
            cut = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))
            pieces = [bytes(self.byte[c] for c in p).decode("utf-8") for p, _ in cut]
        ids: list[int] = []
        table = self.bytes
        for piece in pieces:
            got = self.words.get(piece)
            if got is None:
                got = self.word("".join([table[b] for b in piece.encode("utf-8")]))
                if len(self.words) >= CACHE_ENTRIES:
                    self.words.clear()
                self.words[piece] = got
            ids += got
        return len(ids), " ".join(map(str, ids)), " ".join([self.string[i] for i in ids])

    def text(self, text: str) -> tuple[int, str, str]:
        """``(n, ids joined by spaces, decoded text)`` of a whole text."""
        parts = self.splitter.split(text) if self.splitter and any(a in text for a in self.added) else [text]
        got = []
        cache = self.chunks
        for part in parts:
            if part in self.added:
                got.append((1, str(self.added[part]), part))
                continue
            for c in part.replace("\n", " ").replace("\t", " ").split(" "):
                if not c:
                    continue
                x = cache.get(c)
                if x is None:
                    x = self.chunk(c)
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    if len(c) <= 64:
                        cache[c] = x
                if x[0]:
                    got.append(x)
        return sum([x[0] for x in got]), " ".join([x[1] for x in got]), " ".join([x[2] for x in got])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.text(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.string[i] for i in ids])


def codec(path: str) -> PrefixBPE:
    if path not in _CODECS:
        _CODECS[path] = PrefixBPE(path)
    return _CODECS[path]


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path)
        ids = [bpe.encode(t) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(docs.select(id_col, text_col), f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>", run)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text."""
    def digest(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path)
        n, ids, back = [], [], []
        for t in texts_of(batch.column(1)):
            k, a, b = bpe.text(t)
            n.append(k)
            ids.append(digest(a))
            back.append(digest(b))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)],
                                          names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(id_col, text_col), f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, "
                                                    "ids_sha256 string, decoded_sha256 string", run)
