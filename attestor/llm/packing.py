"""Sum-of-squares packing of tokenised documents into sequences.

Texts are tokenised whole; documents longer than a sequence are cut into full pieces and a last, shorter one. Pieces are
dealt to shards by a hash, each shard of a bounded number of pieces, and placed one by one where the squared counts of open
bins per residual gap become smallest. Counts per gap need no more memory than the capacity, whatever the number of pieces.
Pieces come longest first, so short ones fill what is left.

Defined results: null text is an empty document, which is the end token alone; repeated rows are packed each; an empty
table packs nothing; a null id is kept. Other columns are never read.
"""

import re
import zlib
from array import array
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import array_of, batches_by_bytes, split_words, table, work_dir, written

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 1
#: Pieces of a shard: what one task packs. A shard leaves at most a few open bins.
SHARD = 1 << 16
#: Distinct pre-tokens whose ids a worker keeps (about 100 MB); when full it starts anew.
MOST_KEPT = 400_000
ID_OF = attrgetter("id")
_loaded: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordTokenizer:
    """Ids of single words, exactly as the tokenizer gives them inside a text: none of its tokens spans white space.

    Words of letters below U+0250 skip its normaliser (composed already; lower case code point by code point) and go to
    its model by pre-token, which are kept; all others take the full way.
    """

    ASCII = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+")
    LATIN = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    PLAIN = re.compile(r"[\n!-~]+")
    COMPOSED = re.compile(r"[\n!-~¡-¬®-ɏ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.byte_char = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.place["\n"] = 0  # what separates words has no ids
        self.ids, self.begin = array("I"), array("q", [0, 0])

    def _learn(self, parts: list[str]) -> None:
        """Keep the ids of pre-tokens not met yet. A line break before a word marks one that takes the full way."""
        new = list(set(parts).difference(self.place))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        more, note, tokenize, as_chars = self.ids.extend, self.begin.append, self.model.tokenize, self.byte_char.__getitem__
        for p in new:
            if p[0] == "\n":
                more(self.whole.encode(p[1:], add_special_tokens=False).ids)
            else:
                more(map(ID_OF, tokenize(p if p.isascii() else "".join(map(as_chars, p.encode())))))
            note(len(self.ids))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each word, where they begin, all ids). Words of a kind are cut at once, joined by line breaks."""
        if len(self.place) >= MOST_KEPT:
            self._forget()
        plain, latin, other = [], [], []
        for i, w in enumerate(words):
            (plain if w.isascii() else latin).append(i)
        parts: list[str] = []
        for kind, known, lower, cut in ((plain, self.PLAIN, str.lower, self.ASCII), (latin, self.COMPOSED, lambda x: "".join(map(str.lower, x)), self.LATIN)):
            joined = "\n".join([words[i] for i in kind])
            if kind and ("<|" in joined or not known.fullmatch(joined)):  # some take the full way
                fit = [i for i in kind if "<|" not in words[i] and known.fullmatch(words[i])]
                other += sorted(set(kind).difference(fit))
                kind[:] = fit
                joined = "\n".join([words[i] for i in kind])
            if kind:
                parts += cut.findall(lower(joined))
                parts.append("\n")
        for i in other:
            parts += ["\n" + words[i], "\n"]
        own = np.array(plain + latin + other, np.int64)
        self._learn(parts)
        codes = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        begin, ids = np.array(self.begin, np.int64), np.array(self.ids, np.uint32)
        size = begin[codes + 1] - begin[codes]
        ends = np.cumsum(size)
        flat = ids[np.repeat(begin[codes] - (ends - size), size) + np.arange(int(size.sum()))]
        stop = ends[codes == 0]  # a line break ends each word
        lens, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at[own] = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        lens[own] = np.diff(stop, prepend=0)
        return lens, at, flat


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def token_ids(texts: pa.Array, path: str):
    """The ids of each whole text, its end id included, one array a text."""
    tok = tokenizer(path)
    codes, offsets, words = split_words(texts)
    lens, begin, flats, held = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
    for at in range(0, len(words), 1 << 16):  # so that few words are held as Python objects at a time
        size, start, ids = tok.words(words.slice(at, 1 << 16).to_pylist())
        lens[at : at + len(size)], begin[at : at + len(size)] = size, start + held
        flats.append(ids)
        held += len(ids)
    flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
    for a, b in zip(offsets[:-1], offsets[1:]):
        own = codes[a:b]
        size = lens[own]
        ids = np.empty(int(size.sum()) + 1, "<u4")
        ids[-1] = END_ID
        if len(ids) > 1:
            ids[:-1] = flat[np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(len(ids) - 1)]
        yield ids


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of whole documents."""
    path = path or vocabulary_path()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for t in batches_by_bytes(batches, "text"):
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(token_ids(array_of(t, "text"), path)):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.tolist())
            cols = {"doc_id": array_of(t, "doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield from pa.table(cols | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if with_ids else {})).to_batches()

    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length, placed in the given order; ties go to the fullest bin."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is full, and not open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        rest = capacity - s
        # moving a bin from gap g to g - s changes the sum by 2 (count[g - s] - count[g] + 1); filling it, by 1 - 2 count[g]
        change = 2 * (count[: rest + 1] - count[s:] + 1)
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = never
        best = int(change.argmin())
        if change[best] > (2 * count[rest] + 1 if rest else 0):
            bin_, gap, made = made, capacity, made + 1
        else:
            gap = best + s
            bin_ = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = bin_, capacity - gap
        if gap - s:
            stacks[gap - s].append(bin_)
            count[gap - s] += 1
    return bins, offsets


def pack(parts: DataFrame, *, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """parts with (sequence_id, offset). parts is read twice, so it should be a written table."""
    shards = max(1, -(-parts.count() // shard))
    # the row's place in the written table goes into the hash, so repeated rows are dealt too
    keyed = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(np.int64(key[0]) << 32) + bins, offset=offsets).drop(columns="shard")

    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return keyed.groupBy("shard").applyInPandas(run, schema)


def packed(docs: DataFrame, **how) -> DataFrame:
    return pack(written(pieces(docs, **how), f"{work_dir(docs.sparkSession)}/pieces"))


def op5_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
