"""BPE encoding and decoding of whole texts (op 11) by tree concatenation.

A long text is cut into halves, down to leaves of ``LEAF_CHARS``, wherever the
middle falls, inside a word too. The ids of two halves are joined by encoding a
window around the cut anew: some words on each side and one more on either
edge, whose ids must come out as its half has them. Where an edge disagrees the
window doubles. Inside one pre-token without any cut (thousands of letters in a
row) the same is done with tokens in place of words: byte-pair merges are
decided between neighbours, so a token that a half and the window have in
common at one place separates what lies left of it from what lies right.

Texts of more than ``SPREAD_CHARS`` are cut into segments that different tasks
encode; the segments of a text then meet, and only their joins are encoded
again. Decoding joins the ids' tokens as the tokenizer's ``decode`` does.

Ids are those of the tokenizers library for the given file without special
tokens; added tokens of the file count as the file says. Files whose white
space is not dropped by the model are encoded by pieces of ``tokens.TextIds``.

Defined results: null and empty texts have no ids; rows equal in id and text
give one row each; null ids are kept; an empty table gives no rows; other
columns are ignored. A task holds one text, or the segments of one, at a time.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, keyed, shuffle_partitions
from .tokens import Pieces, TextIds, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
LEAF_CHARS = 2048
# Letters of one pre-token that are encoded at once.
LEAF_LETTERS = 256
SPREAD_CHARS = 1 << 16

# White space to str.split, but not to every regex engine's \\s: it does not
# end a word here.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
_WORD = re.compile("[\\S\x1c-\x1f\x85]+")

Token = tuple[int, int, int]  # id, first letter, end


def split_words(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


class LetterTree:
    """Tree concatenation inside one pre-token, written in byte letters."""

    def __init__(self, model, leaf: int = LEAF_LETTERS) -> None:
        self.model, self.leaf, self.suffix = model, leaf, len(model.end_of_word_suffix or "")
        self.windows = 0  # windows encoded so far

    def tokens(self, letters: str, at: int = 0) -> list[Token]:
        """Tokens by the model alone. Its last token carries the word end."""
        found, out = self.model.tokenize(letters), []
        for i, t in enumerate(found):
            end = at + len(t.value) - (self.suffix if i == len(found) - 1 else 0)
            out.append((t.id, at, end))
            at = end
        return out

    def encode(self, letters: str, a: int = 0, b: int | None = None) -> list[Token]:
        b = len(letters) if b is None else b
        if b - a <= self.leaf:
            return self.tokens(letters[a:b], a)
        middle = (a + b) // 2
        return self.join(letters, self.encode(letters, a, middle), self.encode(letters, middle, b))

    def join(self, letters: str, left: list[Token], right: list[Token]) -> list[Token]:
        k = 2
        while True:
            whole_left, whole_right = k >= len(left), k >= len(right)
            a = left[0][1] if whole_left else left[-k][1]
            b = right[-1][2] if whole_right else right[k - 1][2]
            window = self.tokens(letters[a:b], a)
            self.windows += 1
            if whole_left or window[0] == left[-k]:
                kept = [] if whole_left else left[:-k]
                if whole_right:
                    return kept + window
                # The window's last token ends a word that goes on.
                place = {t: i for i, t in enumerate(right[:k])}
                for i in range(len(window) - 2, -1, -1):
                    if window[i] in place:
                        return kept + window[:i] + right[place[window[i]] :]
            k *= 2


class Words(Pieces):
    """Ids by word; a very long one is encoded by its own tree, and not kept."""

    def __init__(self, tokenizer) -> None:
        super().__init__(tokenizer, "", lower=True)
        self.tree = LetterTree(tokenizer.model)

    def __missing__(self, word: str) -> bytes:
        if len(word) <= LEAF_LETTERS:
            return super().__missing__(word)
        plain = self.tokenizer.normalizer.normalize_str(word)
        out = []
        for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
            out += [t[0] for t in self.tree.encode(letters)]
        return np.array(out, "<u4").tobytes()


class Part:
    """A stretch of text with the ids of each of its words."""

    __slots__ = ("codes", "text")

    def __init__(self, text: str, codes: list[bytes]) -> None:
        self.text, self.codes = text, codes


def _tail(text: str, n: int) -> int:
    """Where the n-th word from the end starts; 0 if there are fewer."""
    look = 64 * n  # mostly few letters are looked at
    while True:
        first = max(0, len(text) - look)
        words = [m.start() for m in _WORD.finditer(text, first)]
        if len(words) > n or not first:
            return words[-n] if len(words) >= n else 0
        look *= 8


def _head(text: str, n: int) -> int:
    """Where the n-th word ends; the end of the text if there are fewer."""
    for i, m in enumerate(_WORD.finditer(text), 1):
        if i == n:
            return m.end()
    return len(text)


class TreeEncoder:
    """Ids of whole texts as packed little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS) -> None:
        self.by_piece, self.leaf = TextIds(path), leaf
        self.tokenizer = self.by_piece.tokenizer
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        loose = any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        # By words only where the model drops white space and no added token depends on what is around it.
        self.by_words = self.by_piece.drops_space and not loose
        self.at_added = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) or r"(?!)")
        self.words = Words(self.tokenizer) if self.by_words else None
        self.windows = 0
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return self.by_piece(text)
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += [self._stretch(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._stretch(text[at:])]) if at else self._stretch(text)

    def _stretch(self, text: str) -> bytes:
        return b"".join(self.part(text).codes)

    def part(self, text: str) -> Part:
        """Text without added tokens, by halves."""
        if len(text) <= self.leaf:
            return Part(text, list(map(self.words.__getitem__, split_words(text))))
        middle = len(text) // 2
        return self.join(self.part(text[:middle]), self.part(text[middle:]))

    def _again(self, window: str) -> bytes:
        self.windows += 1
        if len(window) <= self.leaf:
            return self.by_piece.whole(window)
        return b"".join(map(self.words.__getitem__, split_words(window)))

    def join(self, left: Part, right: Part) -> Part:
        if not left.text or not right.text:
            return left if left.text else right
        text, k = left.text + right.text, 1
        if not left.codes or not right.codes:  # one side is white space
            return Part(text, left.codes + right.codes)
        while True:
            edge_l, edge_r = len(left.codes) > k, len(right.codes) > k
            a = _tail(left.text, k + 1) if edge_l else 0
            b = _head(right.text, k + 1) if edge_r else len(right.text)
            window = left.text[a:] + right.text[:b]
            ids = self._again(window)
            lead = left.codes[-k - 1] if edge_l else b""
            last = right.codes[k] if edge_r else b""
            # Without ids an edge shows nothing.
            agree_l = not edge_l or (lead and ids.startswith(lead))
            agree_r = not edge_r or (last and ids.endswith(last))
            if agree_l and agree_r and len(ids) >= len(lead) + len(last):
                break
            k *= 2
        inner = ids[len(lead) : len(ids) - len(last)]
        words = split_words(window)[edge_l : -1 if edge_r else None]
        codes = list(map(self.words.__getitem__, words))
        if b"".join(codes) != inner:  # keep one entry for each word
            codes = [inner, *[b""] * (len(words) - 1)]
        return Part(text, (left.codes[:-k] if edge_l else []) + codes + (right.codes[k:] if edge_r else []))

    def join_all(self, parts: list[Part]) -> Part:
        """A balanced tree over neighbouring parts."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def decode(self, ids: bytes) -> str:
        """As ``Tokenizer.decode(ids, skip_special_tokens=False)``."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.tokenizer.decoder is None:
            return " ".join(map(self.names.__getitem__, numbers))
        return self.tokenizer.decode(numbers, skip_special_tokens=False)

    def digests(self, ids: bytes) -> tuple[int, str, str]:
        listed = " ".join(map(str, np.frombuffer(ids, "<u4").tolist()))
        return len(ids) // 4, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


@functools.lru_cache(maxsize=4)
def tree_encoder(path: str) -> TreeEncoder:
    """One for each worker and file; its words serve all tasks of the worker."""
    return TreeEncoder(path)


_OUT = "did long, th long, doc_id long, copies long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"
_OUT_ARROW = pa.schema([
    ("did", pa.int64()), ("th", pa.int64()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("n_tokens", pa.int64()),
    ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.large_string()),
])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _result(encoder: TreeEncoder, key: tuple, copies: int, ids: bytes, full: bool) -> tuple:
    return (*key, copies, *encoder.digests(ids), ids if full else None, encoder.decode(ids) if full else None)


def _whole(path: str | None, full: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(path or tokenizer_path(TOKENIZER))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = zip(*(part.column(c).to_pylist() for c in ("did", "th", "doc_id", "text")))
                yield _rows([_result(encoder, key, 1, encoder.encode(text), full) for *key, text in rows], _OUT_ARROW)

    return encode


_SEGMENT = "did long, th long, doc_id long, k long, added int, text string"
_SEGMENT_ARROW = pa.schema([
    ("did", pa.int64()), ("th", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("added", pa.int32()), ("text", pa.large_string()),
])
_CODED = _SEGMENT + ", copies long, sizes binary, ids binary"
_CODED_ARROW = pa.schema([*_SEGMENT_ARROW, ("copies", pa.int64()), ("sizes", pa.binary()), ("ids", pa.binary())])


def _cut(path: str | None, spread: int):
    """Segments of long texts: stretches of ``spread`` characters, wherever
    they end, and the added tokens between them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(path or tokenizer_path(TOKENIZER))
        for batch in batches:
            for i in range(batch.num_rows):
                did, th, doc_id, text = (batch.column(c)[i].as_py() for c in ("did", "th", "doc_id", "text"))
                k, at = 0, 0
                for m in [*encoder.at_added.finditer(text), None]:
                    end = m.start() if m else len(text)
                    for a in range(at, end, spread):
                        yield _rows([(did, th, doc_id, k, None, text[a : min(a + spread, end)])], _SEGMENT_ARROW)
                        k += 1
                    if m:
                        yield _rows([(did, th, doc_id, k, encoder.added[m[0]], "")], _SEGMENT_ARROW)
                        k, at = k + 1, m.end()

    return cut


def _code(path: str | None):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(path or tokenizer_path(TOKENIZER))
        for batch in batches:
            for i in range(batch.num_rows):
                row = tuple(batch.column(f.name)[i].as_py() for f in _SEGMENT_ARROW)
                codes = encoder.part(row[-1]).codes
                sizes = np.array([len(c) for c in codes], "<u4").tobytes()
                yield _rows([(*row, batch.column("copies")[i].as_py(), sizes, b"".join(codes))], _CODED_ARROW)

    return code


def _assemble(path: str | None, full: bool):
    """Sorted segments to texts: joins between neighbours, one text at a time."""

    def finish(encoder: TreeEncoder, key: tuple, copies: int, done: list[bytes], parts: list[Part]) -> pa.RecordBatch:
        ids = b"".join([*done, *(encoder.join_all(parts).codes if parts else [])])
        return _rows([_result(encoder, key, copies, ids, full)], _OUT_ARROW)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(path or tokenizer_path(TOKENIZER))
        key, copies, done, parts = None, 0, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f.name: batch.column(f.name)[i].as_py() for f in _CODED_ARROW}
                own = (row["did"], row["th"], row["doc_id"])
                if own != key:
                    if key is not None:
                        yield finish(encoder, key, copies, done, parts)
                    key, copies, done, parts = own, row["copies"], [], []
                if row["added"] is not None:
                    done += [*(encoder.join_all(parts).codes if parts else []), row["added"].to_bytes(4, "little")]
                    parts = []
                    continue
                ends = np.cumsum(np.frombuffer(row["sizes"], "<u4").astype(np.int64)).tolist()
                parts.append(Part(row["text"], [row["ids"][a:b] for a, b in zip([0, *ends], ends)]))
        if key is not None:
            yield finish(encoder, key, copies, done, parts)

    return assemble


def encode_documents(docs: DataFrame, tokenizer: str | None = None, spread: int = SPREAD_CHARS, full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, with ``ids``
    (packed 32-bit) and ``decoded`` if asked for. ``tokenizer`` is the path of a
    tokenizers file that every executor can read. The file's white space must be
    dropped by the model for texts longer than ``spread`` to be cut."""
    rows = keyed(docs)
    parts = shuffle_partitions(docs.sparkSession)
    short = rows.where(F.length("text") <= spread).mapInArrow(_whole(tokenizer, full), _OUT)
    segments = rows.where(F.length("text") > spread).mapInArrow(_cut(tokenizer, spread), _SEGMENT)
    # Equal rows are encoded once; segments of one text go to many tasks.
    once = segments.groupBy("did", "th", "doc_id", "k", "added").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    coded = once.select(*_SEGMENT_ARROW.names, "copies").mapInArrow(_code(tokenizer), _CODED)
    whole = (
        coded.repartition(parts, "did", "th", "doc_id").sortWithinPartitions("did", "th", "doc_id", "k")
        .mapInArrow(_assemble(tokenizer, full), _OUT)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .drop("copy")
    )
    return short.unionByName(whole).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * full)


def op11(spark, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
