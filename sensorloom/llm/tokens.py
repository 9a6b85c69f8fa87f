"""Token ids of whole texts with a public tokenizer file.

Both vocabularies split a text into words before they merge, so a text's ids are those of its pieces in a row, wherever the
pieces are cut between words. Cuts are set with Arrow's string functions; each distinct piece of a slice is looked up once.
Python workers keep the ids of pieces they have met lately; only new pieces reach the tokenizer, many at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs

#: Unicode's White_Space characters but space and newline, then all (fixed values).
OTHER_SPACE = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_SPACE = OTHER_SPACE + " \n"
#: Letters and digits that stay one letter or digit in lower case, and ASCII's punctuation: words end between the two.
WORD_END = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{410}-\x{44F}])([!-/:-@\[-`{-~])"
#: Pieces kept per worker, about, and the longest that is kept or encoded in a row of others.
KEPT_PIECES, KEPT_CHARS = 400_000, 64
SLICE_BYTES = 8 << 20


class Encoder:
    """encode(texts) -> for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, white_space_counts: bool) -> None:
        from tokenizers import Tokenizer

        fs, place = pafs.FileSystem.from_uri(path) if "://" in path else (None, path)
        self.tokenizer = Tokenizer.from_buffer(fs.open_input_file(place).read()) if fs else Tokenizer.from_file(place)
        self.tokenizer.encode_special_tokens = True
        w = WHITE_SPACE
        self.white = white_space_counts
        self.pieces = re.compile(f"[{w}]*[^{w}]+|[{w}]+").findall
        #: Texts with white space other than single spaces and up to two newlines between words, or with the mark used for cutting.
        self.uneven = f"\x00|[{w}] | [{w}]|^ | $|\n\n\n|\n\n$|[{OTHER_SPACE}]\n|\n[{OTHER_SPACE}]"
        #: Pieces that can't stand in a row of others.
        self.alone = f"(?s)^.+[{w}]|^[\n{OTHER_SPACE}]|^.{{{KEPT_CHARS}}}." + ("" if self.white else "|~")
        self.between = "\n" if self.white else " ~ "
        self.marks = self.tokenizer.encode(self.between.strip(" "), add_special_tokens=False).ids
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        if not self.white:  # white space is dropped, so a space may stand at every cut
            return self._joined(pc.split_pattern(pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), WORD_END, r"\1 \2"), " "))
        uneven = pc.match_substring_regex(texts, self.uneven)
        marked = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(uneven)), " ", "\x00 "), "\n", "\x00\n\x00")
        even = self._joined(pc.split_pattern(pc.replace_substring_regex(marked, WORD_END, "\\1\x00\\2"), "\x00"))
        if len(even) == len(texts):
            return even
        odd = texts.filter(uneven).to_pylist()
        others = self._joined(pa.array([self.pieces(t) for t in odd], pa.list_(pa.string())))
        sides = (iter(even), iter(others))
        return [next(sides[k]) for k in uneven.to_pylist()]

    def _joined(self, pieces: pa.ListArray) -> list[bytes]:
        """Pieces of each text -> the text's ids: each distinct piece is looked up once, the rest is taken by number."""
        flat = pieces.flatten().dictionary_encode()
        ids = self._ids(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        codes = flat.indices
        taken = table.take(codes).flatten().to_numpy().tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(sizes[codes.to_numpy()])])
        cuts = ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()].tolist()
        return [taken[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Pieces met since the last change of generation are young; those only met in the one before it are old, and go at the next."""
        young, old = self.young, self.old
        out: list[bytes | None] = list(map(young.get, pieces))
        new: list[int] = []
        for i, known in enumerate(out):
            if known is None:
                p = pieces[i]
                out[i] = again = old.get(p)
                if again is None:
                    new.append(i)
                else:
                    young[p] = again
        for i, ids in zip(new, self._encoded([pieces[i] for i in new]), strict=True):
            out[i] = ids
            if len(pieces[i]) <= KEPT_CHARS:
                young[pieces[i]] = ids
        if len(young) > KEPT_PIECES // 2:
            self.young, self.old = {}, young
        return out

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Short plain pieces are encoded many in a row, with a separator between that none of them holds; others alone."""
        out: list[bytes] = [b""] * len(pieces)
        apart = np.array(pc.match_substring_regex(pa.array(pieces, pa.string()), self.alone), bool)
        alone, rows = np.flatnonzero(apart).tolist(), np.flatnonzero(~apart).tolist()
        for at in range(0, len(rows), 256):
            own = rows[at : at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join([pieces[i] for i in own])], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(ids == self.marks[0])).tolist()
            if len(self.marks) > 1 or len(cuts) != len(own) - 1:
                alone += own
                continue
            raw = ids.tobytes()
            for i, a, b in zip(own, [0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True):
                out[i] = raw[a:b]
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE_BYTES of the given text column, so long texts make no large slice."""
    sizes = pc.cumulative_sum(pc.binary_length(batch.column(column)).cast(pa.int64())).to_numpy()
    begin = 0
    while begin < batch.num_rows:
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + SLICE_BYTES)))
        yield batch.slice(begin, end - begin)
        begin = end


@lru_cache(maxsize=4)
def encoder(path: str, white_space_counts: bool) -> Encoder:
    """One encoder per worker and file. Tokenizer threads stay off: Spark's tasks fill the cores."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, white_space_counts)
