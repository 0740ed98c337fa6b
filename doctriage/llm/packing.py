"""Packing of tokenised documents into sequences, first-fit decreasing.

Documents are dealt to groups at random. Each group is packed in a task of its own: full
sequences are cut off long documents; what remains goes, largest first, into the first
sequence with room, which a tournament tree over the free room finds. The emptiest
sequences are then cut up to fill the holes of the others, and what is left over makes
sequences of a power of two, so that nothing is padded.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 1024
END_ID = 0
GROUP_DOCUMENTS = 1024      # documents of a group, on average
CACHE_PIECES = 500_000      # pieces of text whose ids a worker keeps
BLOCK = 256                 # texts encoded together
_GAP = re.compile(r"\s[ \n]")     # white space before a place to cut
# Letters of Latin-1 and what may stand after them, each a token of its own to the tokenizer.
_WORD = re.compile(r"(\n?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?%#)]*)")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def byte_level(text: str) -> str:
    """A text as byte-level tokenizers spell it: a character for each byte of its UTF-8."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", "\u0120")
    return text.encode().decode("latin-1").translate(_BYTES)


def tokenizer_path(name: str) -> str:
    """Where the installed tokenizers keep a file; a full path stays as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, with the ids of frequent pieces kept.

    The tokenizer never joins characters across the start of a space or line end that follows
    another character than white space, so a text is cut there, and the ids of the pieces
    are put together. A text with other white space before a space or line end, or at either of
    its ends, is encoded in one. New pieces are encoded together, one to a line: a line end there
    is a token of its own. Words are cut, and told apart, a block of texts at a time.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end, = self.ids("\n")
        self.kept: dict[str, bytes] = {"": b""}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()

    def pieces(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word after a space, or after the line end that it starts with."""
        odd = {w for s in self.special for w in words if s in w}
        out = {w: self.whole(w if w[0] == "\n" else f" {w}") for w in odd}
        plain = [w for w in words if w not in odd]
        found = list(map(_WORD.fullmatch, plain))
        out |= self.letters({m[1] for m in found if m}.difference(self.kept))
        lines = [w for w, m in zip(plain, found) if not m]
        first = np.array([self.line_end], "<u4").tobytes()
        ids = np.array(self.ids("".join([f"{w[1:]}\n" if w[0] == "\n" else f" {w}\n" for w in lines])),
                       "<u4")
        ends = np.flatnonzero(ids == self.line_end)
        data, starts = ids.tobytes(), np.r_[0, ends + 1][:-1]
        out.update((w, first + data[a:b] if w[0] == "\n" else data[a:b]) for w, a, b in
                   zip(lines, (4 * starts).tolist(), (4 * ends).tolist(), strict=True))
        tails = {t: self.whole(t) if t else b"" for t in {m[2] for m in found if m}}
        out.update([(m[0], (out.get(m[1]) or self.kept[m[1]]) + tails[m[2]]) for m in found if m and m[2]])
        return out

    def letters(self, words: set[str]) -> dict[str, bytes]:
        """The same of words of letters only, which need no search for where to cut them."""
        tokenize, sizes, ids = self.tokenizer.model.tokenize, [], []
        for w in words:
            # The start is a token with the word after a space, one of its own after a line end.
            if after_line := w[0] == "\n":
                ids.append(self.line_end)
            own = tokenize(byte_level(w[1:] if after_line else f" {w}"))
            ids += [t.id for t in own]
            sizes.append(len(own) + after_line)
        data, ends = np.array(ids, "<u4").tobytes(), np.cumsum([0, *sizes]) * 4
        return {w: data[a:b] for w, a, b in zip(words, ends[:-1].tolist(), ends[1:].tolist())}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        out = [self.whole(t) if not t or t[0].isspace() or t[-1].isspace() or _GAP.search(t) else None
               for t in texts]
        # Each text as if after a line end, whose id is left out again.
        cut = pc.split_pattern(pc.replace_substring(pa.array(
            [f"\n{t}" for t, b in zip(texts, out) if b is None], pa.large_string()), "\n", " \n"), " ")
        if not len(cut):
            return out
        words = pc.dictionary_encode(cut.flatten())
        names, known = words.dictionary.to_numpy(zero_copy_only=False).tolist(), self.kept
        each = list(map(known.get, names))
        if missing := [w for w, b in zip(names, each) if b is None]:
            found = self.pieces(missing)
            each = [found[w] if b is None else b for w, b in zip(names, each)]
            if len(known) + len(found) <= CACHE_PIECES:
                known.update(found)
        ids, sizes = np.frombuffer(b"".join(each), "<u4"), np.array([len(b) for b in each]) // 4
        code = words.indices.to_numpy()
        size = sizes[code]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[code] - ends + size, size)
        data, at = ids[place].tobytes(), 4 * np.r_[0, ends][cut.offsets.to_numpy()]
        found_texts = (data[a + 4:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
        return [next(found_texts) if b is None else b for b in out]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Tournament:
    """Free room of the bins; a parent holds the larger room of its two children."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [room] * (2 * self.leaves)

    def first_with(self, size: int) -> int:
        """The leftmost bin with room for ``size``."""
        at = 1
        while at < self.leaves:
            at *= 2
            if self.best[at] < size:
                at += 1
        return at - self.leaves

    def take(self, bin_: int, size: int) -> None:
        at = bin_ + self.leaves
        self.best[at] -= size
        while at > 1:
            at //= 2
            self.best[at] = max(self.best[2 * at], self.best[2 * at + 1])


Piece = tuple[int, int, int]        # document, start, length


def first_fit_decreasing(items: list[Piece], length: int) -> list[list[Piece]]:
    tree = Tournament(len(items), length)
    bins: list[list[Piece]] = [[] for _ in items]
    for item in sorted(items, key=lambda p: (-p[2], p[0], p[1])):
        at = tree.first_with(item[2])
        tree.take(at, item[2])
        bins[at].append(item)
    return [b for b in bins if b]


def filled(bins: list[list[Piece]], length: int) -> list[list[Piece]]:
    """The bins, the emptiest cut up to fill the others; the rest in powers of two."""
    room = lambda b: length - sum(p[2] for p in b)
    order = sorted(bins, key=room)
    done: list[list[Piece]] = []
    loose: list[Piece] = []         # pieces of a bin that was cut up
    while order:
        current = order.pop(0)
        space = room(current)
        while space and (loose or order):
            loose = loose or order.pop()
            doc, start, size = loose.pop()
            fits = min(size, space)
            current.append((doc, start, fits))
            space -= fits
            if size > fits:
                loose.append((doc, start + fits, size - fits))
        if space:                   # nothing is left to fill this one with
            return done + powers(current)
        done.append(current)
    return done + powers(loose)


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences of the powers of two that the pieces' total is made of, largest first."""
    left, out = list(reversed(pieces)), []
    total = sum(p[2] for p in pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        want, sequence = total & (1 << bit), []
        while want:
            doc, start, size = left.pop()
            fits = min(size, want)
            sequence.append((doc, start, fits))
            want -= fits
            if size > fits:
                left.append((doc, start + fits, size - fits))
        if sequence:
            out.append(sequence)
    return out


def pack_lengths(lengths: list[int], length: int = LENGTH) -> list[list[Piece]]:
    """Sequences for documents of these token counts."""
    full, rest = [], []
    for doc, n in enumerate(lengths):
        full += [[(doc, at, length)] for at in range(0, n - length + 1, length)]
        if n % length:
            rest.append((doc, n - n % length, n % length))
    return full + filled(first_fit_decreasing(rest, length), length)


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         tokenizer: str = TOKENIZER, length: int = LENGTH,
         group_documents: int = GROUP_DOCUMENTS, group: Column | None = None) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the ids of its whole text, then id 0; a null text is empty. Sequences
    hold at most ``length`` ids, and all that are shorter have a power of two of them, at
    most one of each power for each group. Groups are drawn by a hash of id and text, so
    one source or a long run of ids doesn't make a large one; repeated rows are packed
    each. With a ``group``, a whole number, its equal values make the groups instead, and
    sequence ids follow its order. Token ids are made and used within the group's task; only the text is shuffled.
    """
    groups = max(1, -(-docs.count() // group_documents)) if group is None else 0

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        encode = encoder(tokenizer_path(tokenizer)).encode
        end = np.array([END_ID], "<u4").tobytes()
        pdf = pdf.sort_values("order", kind="stable")
        texts = [t or "" for t in pdf["text"]]
        ids = [b + end for at in range(0, len(texts), BLOCK) for b in encode(texts[at:at + BLOCK])]
        names = pdf["id"].tolist()
        rows = []
        for number, sequence in enumerate(pack_lengths([len(b) // 4 for b in ids], length)):
            offset = 0
            for doc, start, size in sequence:
                crc = zlib.crc32(ids[doc][4 * start:4 * (start + size)])
                rows.append((names[doc], start, size, crc, len(ids[doc]) // 4,
                             int(key[0]) << 32 | number, offset))
                offset += size
        out = pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens",
                                          "sequence_id", "offset"])
        out["id"] = out["id"].astype("Int64")
        return out

    order = F.xxhash64(id_column, text_column)
    return (docs.select(F.col(id_column).cast("bigint").alias("id"),
                        F.col(text_column).alias("text"), order.alias("order"),
                        (F.pmod(order, F.lit(groups)) if group is None else group).alias("group"))
            .groupBy("group").applyInPandas(
                run, "id bigint, start bigint, length bigint, ids_crc32 bigint, "
                     "doc_tokens bigint, sequence_id bigint, offset bigint")
            .withColumnRenamed("id", id_column))
