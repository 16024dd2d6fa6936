"""How the tokens of two tokenizers meet, by inverted bitmaps of token pairs.

A text is encoded twice. Where a token of A and a token of B end at the same byte,
the two are linked, and the ends that both share cut the text into groups. Links
are counted over the corpus by an inverted index: for each pair of ids and block
of texts there is a compressed bitmap of the texts that hold the pair, and planes
of the binary digits of how often they hold it beyond once. Bitmaps of the parts of
a block are merged by OR as they are made, and those of different blocks cover
different texts; their set bits add up to the texts of a pair, and those of its
planes to its links. The scores go back the way the counts came: a posting that is
joined with its pair's score gives it to the texts in its bitmap.

A pair has one posting a block and plane, however many texts hold it, so no key is
hot beyond the number of blocks; a task holds one block. The two largest tables,
texts and postings, are written once to the shared folder.

Encoding: texts are cut before a blank or a line break that follows a plain sign.
Neither tokenizer ever joins signs over such a place (this is checked against the
files; for other kinds of tokenizer a text stays whole), so a stretch is encoded
once and kept by its worker. Special tokens in a text are plain text.

Null and empty texts, and texts whose tokens do not spell them, have no tokens:
all counts are zero and the digest is empty. Repeated rows and ids are texts of
their own. An empty table gives no rows. A long text makes a block of its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpuskit.llm.arrays import owners, slices, utf8, worker_value
from corpuskit.session import shared_folder

BLOCK_BYTES = 1 << 23
BLOCK_TEXTS = 1 << 16  # a text's number in its block fits 16 bits
KEPT_STRETCHES = 400_000  # per worker; then it starts afresh
KEPT_BYTES = 64  # a longer stretch is not kept
BATCH_STRETCHES = 2000
ODD = "▁"  # what B writes for a blank
ODD_BYTES = ODD.encode()

# Safe signs before a cut: printable ASCII, and signs of two or three bytes whose
# first byte starts no blank (those start with C2, E1, E2 or E3).
PLAIN = np.zeros(256, bool)
PLAIN[0x21:0x7F] = True
LEAD2 = np.zeros(256, bool)
LEAD2[0xC3:0xE0] = True
LEAD3 = np.zeros(256, bool)
LEAD3[[0xE0, *range(0xE4, 0xF0)]] = True


def byte_of_sign() -> dict[str, int]:
    """The bytes that the signs of a byte-level vocabulary stand for: printable
    Latin-1 stands for itself, all other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


class PairEncoder:
    """Both tokenizers, with what is known of the stretches seen."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        sign = byte_of_sign()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(sign[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(ODD, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in both], np.int64) for both in (self.a_bytes, self.b_bytes))
        self.cuts = self._may_cut(a_path, b_path, pieces)
        self.forget()

    def _may_cut(self, a_path: str, b_path: str, pieces: list[str]) -> bool:
        spec = json.loads(self.a.to_str())
        before = spec.get("pre_tokenizer") or {}
        plain_a = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        try:
            from sentencepiece import sentencepiece_model_pb2

            model = sentencepiece_model_pb2.ModelProto()
            with open(b_path, "rb") as f:
                model.ParseFromString(f.read())
            rule = model.normalizer_spec
            plain_b = rule.name == "identity" and rule.add_dummy_prefix and not rule.remove_extra_whitespaces and model.trainer_spec.model_type == 2
        except ImportError:
            return False
        joins = any(ODD in p.lstrip(ODD) or "\n" in p for i, p in enumerate(pieces) if not self.b.is_byte(i))
        return bool(plain_a and plain_b and not joins)

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.good: list[bool] = []
        self.groups: list[bytes] = []  # the stretch's groups, spelled out
        self.sizes: list[tuple[int, int, int]] = []  # tokens of A, of B, groups
        self.pairs: list[np.ndarray] = []  # linked ids, A's in the upper half

    def places(self, stretches: list[bytes]) -> list[int]:
        """Numbers of the given stretches; new ones are encoded."""
        new = list(dict.fromkeys(s for s in stretches if s not in self.known))
        at = {}
        for i in range(0, len(new), BATCH_STRETCHES):
            part = new[i : i + BATCH_STRETCHES]
            # A stretch that ends in a blank would run on into the next.
            joined = [s for s in part if len(s) <= KEPT_BYTES and ODD_BYTES not in s and not s.decode()[-1].isspace()]
            if not self.cuts or not self._learn(joined, at):
                joined = []
            for s in part if not joined else set(part).difference(joined):
                if not self.cuts or not self._learn([s], at):
                    self._whole(s, at)
        self.known.update((s, n) for s, n in at.items() if len(s) <= KEPT_BYTES)
        return [at[s] if s in at else self.known[s] for s in stretches]

    def _add(self, at: dict, stretch: bytes, good: bool, groups: bytes, sizes, pairs) -> None:
        at[stretch] = len(self.good)
        self.good.append(good)
        self.groups.append(groups)
        self.sizes.append(sizes)
        self.pairs.append(pairs)

    def _learn(self, stretches: list[bytes], at: dict) -> bool:
        """Encodes stretches behind one another; False if they do not come apart."""
        if not stretches:
            return True
        # One sign goes before, so that B's own blank is not the first stretch's.
        body = b"a" + b"".join(stretches)
        text = body.decode()
        ids_a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        ids_b = np.array(self.b.encode(text), np.int64)
        if b"".join(self.a_bytes[i] for i in ids_a) != body or b"".join(self.b_bytes[i] for i in ids_b) != b" " + body:
            return False
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b]) - 1
        borders = np.cumsum([1, *map(len, stretches)])
        shared = np.intersect1d(ends_a, ends_b)
        if len(np.intersect1d(shared, borders)) != len(borders):
            return False
        self._groups(stretches, borders, shared, ids_a, ends_a, ids_b, ends_b, at)
        return True

    def _groups(self, stretches, borders, shared, ids_a, ends_a, ids_b, ends_b, at) -> None:
        last_a, last_b = np.searchsorted(ends_a, shared, side="right"), np.searchsorted(ends_b, shared, side="right")
        linked = (ids_a[last_a - 1] << 32) | ids_b[last_b - 1]
        cut = np.searchsorted(shared, borders, side="right")
        to_a, to_b = last_a[cut - 1], last_b[cut - 1]
        spelled_a, spelled_b = [b"%d" % i for i in ids_a.tolist()], [b"%d" % i for i in ids_b.tolist()]
        last_a, last_b, cut = last_a.tolist(), last_b.tolist(), cut.tolist()
        for n, stretch in enumerate(stretches):
            first, stop = cut[n], cut[n + 1]
            groups = b";".join(
                b",".join(spelled_a[last_a[g - 1] : last_a[g]]) + b"|" + b",".join(spelled_b[last_b[g - 1] : last_b[g]]) for g in range(first, stop)
            )
            self._add(at, stretch, True, groups, (int(to_a[n + 1] - to_a[n]), int(to_b[n + 1] - to_b[n]), stop - first), linked[first:stop])

    def _whole(self, text: bytes, at: dict) -> None:
        """A whole text that begins with the blank, encoded by itself."""
        body = text.decode()
        ids_a = np.array(self.a.encode(body, add_special_tokens=False).ids, np.int64)
        # Without its own blank, as B adds it; a cut stretch may begin with a break.
        lead = body[:1] == " "
        ids_b = np.array(self.b.encode(body[1:] if lead else body), np.int64)
        spelled = b"".join(self.a_bytes[i] for i in ids_a) == text and b"".join(self.b_bytes[i] for i in ids_b) == text
        if not spelled or not len(text):
            self._add(at, text, False, b"", (0, 0, 0), np.zeros(0, np.int64))
            return
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        shared = np.intersect1d(ends_a, ends_b)
        # As in `_learn`, with an empty token in front.
        zero = np.zeros(1, np.int64)
        self._groups(
            [text], np.array([0, len(text)]), np.concatenate([zero, shared]), np.concatenate([zero, ids_a]), np.concatenate([zero, ends_a]),
            np.concatenate([zero, ids_b]), np.concatenate([zero, ends_b]), at,
        )


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts and the stretches in them begin: at every text's first byte, and
    before a blank or line break that follows a plain sign."""
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    begins = border[:-1].copy()
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[at > 0]
    before = data[at - 1]
    plain = PLAIN[before]
    follow = (before & 0xC0) == 0x80
    second = data[np.maximum(at - 2, 0)]
    plain |= follow & LEAD2[second] & (at > 1)
    plain |= follow & ((second & 0xC0) == 0x80) & LEAD3[data[np.maximum(at - 3, 0)]] & (at > 2)
    begins[at[plain]] = True
    return np.flatnonzero(begins)


def _with_blank(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that are not empty with a blank before each."""
    sizes = np.diff(offsets)
    return np.insert(data, offsets[:-1][sizes > 0], 0x20), np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])


def planes(pair: np.ndarray, text: np.ndarray, texts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bool], list[bytes]]]:
    """(plane, pairs, set bits, is a bitmap, bits) of a block's links.

    Plane 0 has the texts of a pair, plane p the digit 2^(p-1) of the links beyond
    the first. Set bits are listed as 16-bit numbers, or as a map of all texts of
    the block where that is smaller.
    """
    keys, links = np.unique(pair * BLOCK_TEXTS + text, return_counts=True)
    plane, more = 0, links - 1
    while plane == 0 or (more >> (plane - 1)).any():
        chosen = keys if plane == 0 else keys[more >> (plane - 1) & 1 == 1]
        held = chosen // BLOCK_TEXTS
        numbers = (chosen % BLOCK_TEXTS).astype("<u2")
        begin = np.flatnonzero(np.diff(held, prepend=-1))
        size = np.diff(np.append(begin, len(chosen)))
        dense = size * 2 > (texts + 7) // 8
        listed, bits = numbers.tobytes(), []
        for a, n, full in zip(begin.tolist(), size.tolist(), dense.tolist()):
            if full:
                mark = np.zeros(texts, np.uint8)
                mark[numbers[a : a + n]] = 1
                bits.append(np.packbits(mark, bitorder="little").tobytes())
            else:
                bits.append(listed[2 * a : 2 * (a + n)])
        yield plane, held[begin], size, dense.tolist(), bits
        plane += 1


def texts_of(dense: bool, bits: bytes) -> np.ndarray:
    """The numbers of the texts in a bitmap."""
    if dense:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    return np.frombuffer(bits, "<u2").astype(np.int64)


def _rows(id_type: str) -> str:
    return (
        f"posting boolean, block long, text int, id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "a int, b int, plane int, texts long, dense boolean, bits binary"
    )


def encode(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with their counts and digests, and postings of token pairs, as rows of
    one table in the shared folder (`posting` tells them apart): reading and
    encoding happen once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType.fromDDL(_rows(asked.schema["id"].dataType.simpleString()))
    fields = to_arrow_schema(schema)

    def rows(**columns) -> pa.RecordBatch:
        count = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in fields], schema=fields)

    def block(encoder: PairEncoder, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, name: int) -> Iterator[pa.RecordBatch]:
        texts = len(ids)
        data, offsets = _with_blank(data, offsets)
        begin = stretches(data, offsets) if encoder.cuts else np.unique(offsets[:-1][np.diff(offsets) > 0])
        whole = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = whole.dictionary_encode()
        if len(encoder.good) > KEPT_STRETCHES:
            encoder.forget()
        place = np.array(encoder.places(coded.dictionary.to_pylist()), np.int64)[coded.indices.to_numpy()] if len(begin) else np.zeros(0, np.int64)
        owner = owners(begin, offsets)
        known, which = np.unique(place, return_inverse=True)
        good = np.ones(texts, bool)
        good[owner[~np.array([encoder.good[i] for i in known], bool)[which]]] = False
        good &= np.diff(offsets) > 0
        kept = good[owner]
        owner, which = owner[kept], which[kept]
        sizes = np.array([encoder.sizes[i] for i in known], np.int64).reshape(-1, 3)
        totals = np.stack([np.bincount(owner, weights=sizes[which, i], minlength=texts).astype(np.int64) for i in range(3)])
        spelled = [encoder.groups[i] for i in known]
        border = np.searchsorted(owner, np.arange(texts + 1)).tolist()
        parts = which.tolist()
        digests = [hashlib.sha256(b";".join([spelled[i] for i in parts[a:b]])).hexdigest() if b > a else "" for a, b in zip(border, border[1:])]
        # Links: the pairs of every stretch, once for each time that it stands there.
        lists = [encoder.pairs[i] for i in known]
        length = np.array([len(x) for x in lists], np.int64)
        pool = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        pairs, code = np.unique(pool, return_inverse=True)
        first = np.cumsum(length) - length
        per = length[which]
        ends = np.cumsum(per)
        at = np.repeat(first[which] - ends + per, per) + np.arange(ends[-1] if len(ends) else 0)
        text = np.repeat(owner, per)
        yield rows(
            posting=np.zeros(texts, bool), block=np.full(texts, name), text=np.arange(texts, dtype=np.int32), id=ids,
            n_a=totals[0], n_b=totals[1], n_groups=totals[2], n_links=np.bincount(text, minlength=texts), groups_sha256=digests,
        )
        for plane, held, count, dense, bits in planes(code[at], text, texts):
            found = pairs[held]
            yield rows(
                posting=np.ones(len(held), bool), block=np.full(len(held), name), a=(found >> 32).astype(np.int32), b=(found & 0xFFFFFFFF).astype(np.int32),
                plane=np.full(len(held), plane, np.int32), texts=count, dense=dense, bits=bits,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_value(f"pair encoder {a_path} {b_path}", lambda: PairEncoder(a_path, b_path))
        for ids, data, offsets in _blocks(batches):
            yield from block(encoder, ids, data, offsets, uuid.uuid4().int >> 65)

    path = f"{shared_folder(spark)}/token-pairs-{uuid.uuid4().hex}"
    asked.mapInArrow(run, schema).write.parquet(path)
    return spark.read.parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids and texts of about `BLOCK_BYTES`, over the borders of batches."""
    held, size, count = [], 0, 0
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for first, last in slices(offsets, BLOCK_BYTES):
            for a in range(first, last, BLOCK_TEXTS):
                z = min(last, a + BLOCK_TEXTS)
                more = int(offsets[z] - offsets[a])
                if held and (size + more > BLOCK_BYTES or count + z - a > BLOCK_TEXTS):
                    yield _laid(held)
                    held, size, count = [], 0, 0
                held.append((batch.column(0).slice(a, z - a), data[offsets[a] : offsets[z]], np.diff(offsets[a : z + 1])))
                size, count = size + more, count + z - a
    if held:
        yield _laid(held)


def _laid(held) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids, data, sizes = zip(*held)
    return pa.concat_arrays(ids), np.concatenate(data), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(a, b, texts, links, best): in how many texts a pair is linked and how often,
    and whether no other pair of the same B id is linked more often. A B id meets
    at most as many ids as A has, so its window is bounded by a vocabulary."""
    counted = encoded.where("posting").groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("texts")).otherwise(0)).alias("texts"), F.sum(F.expr("shiftleft(texts, greatest(plane - 1, 0))")).alias("links")
    )
    return counted.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a
    text. n_best: links whose pair is the corpus's most frequent of its B id, ties
    included; count_sum: the corpus counts of the pairs, summed over links."""
    encoded = encode(docs, a_path, b_path, id_col, text_col)
    texts = encoded.where("NOT posting").select("block", "text", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    counts = pair_counts(encoded).select("a", "b", "links", "best")
    scored = encoded.where("posting").select("block", "a", "b", "plane", "dense", "bits").join(counts, ["a", "b"]).select(F.col("block").alias("home"), "plane", "dense", "bits", "links", "best")

    def give(own: pa.Table, postings: pa.Table) -> pa.Table:
        n = own.num_rows
        number = own.column("text").to_numpy()
        size = int(number.max()) + 1 if n else 0
        best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        columns = (postings.column(c).to_pylist() for c in ("plane", "dense", "bits", "links", "best"))
        for plane, dense, bits, links, is_best in zip(*columns):
            at, weight = texts_of(dense, bits), 1 << max(plane - 1, 0)
            total[at] += links * weight  # a bitmap holds a text once
            if is_best:
                best[at] += weight
        out = own.drop_columns(["block", "text"])
        return out.append_column("n_best", pa.array(best[number])).append_column("count_sum", pa.array(total[number]))

    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return texts.groupBy("block").cogroup(scored.groupBy("home")).applyInArrow(give, schema)
