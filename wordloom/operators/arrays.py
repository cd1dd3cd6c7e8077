"""Token lookups over documents as arrays (J1 without a shuffle of every token).

A document's tokens stay together in one row.  The most frequent tokens of the
vocabulary, a bounded number of bounded length, are broadcast and looked up
where the document is read; only the other tokens travel to the vocabulary, each
as a row, and come back to their document.  What is shuffled is one array of ids
for each document and the rare tokens.

The encoded form is a row for each ``doc_id``: ``doc_id, pos, ids[, occurrences,
frequency]``, in the order of (position, id).  ``pos`` is null where the
positions are 0..n-1; else (rows that share a doc_id, tokens without an id) it
has the position of each id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Most tokens, and longest ones in code points, that are looked up where a document is read.
HOT_TOKENS, HOT_LENGTH = 200_000, 64
#: Stands for an id that is not known.
NO_ID = np.iinfo(np.int64).min


def least_count(counted: DataFrame, most: int) -> int | None:
    """The least of ``occurrences`` that no more than ``most`` rows reach, from a row for each different count; None if there is none."""
    counts = counted.groupBy("occurrences").agg(F.count(F.lit(1)).alias("n")).toArrow()
    occurrences, n = counts.column(0).to_numpy(), counts.column(1).to_numpy()
    order = np.argsort(-occurrences)
    fit = occurrences[order][np.cumsum(n[order]) <= most]
    return int(fit[-1]) if len(fit) else None


def hot_tokens(vocab: DataFrame, most: int = HOT_TOKENS, longest: int = HOT_LENGTH) -> pa.Table:
    """The vocabulary's rows of the tokens that occur most often: at most ``most``, of at most ``longest`` characters.

    """
    short = vocab.filter(F.length("token") <= longest)
    least = least_count(short, most)
    return (short.limit(0) if least is None else short.filter(F.col("occurrences") >= least)).toArrow()


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _offsets(column) -> np.ndarray:
    """Where each row's list begins and ends in ``column.flatten()``."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def count_array_tokens(arrays: DataFrame) -> DataFrame:
    """``token, doc_id, pos, n`` for every different token of an Arrow batch of ``(doc_id, tokens)``.

    ``n`` counts the token in the batch, ``doc_id, pos`` is its first place by document and position;
    a document without a doc_id comes after all others.
    """
    def run(batches):
        for b in batches:
            values, at = b.column("tokens").flatten(), _offsets(b.column("tokens"))
            if not len(values):
                continue
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            pos = np.arange(len(values)) - at[doc]
            docs = b.column("doc_id")
            rank = pc.rank(docs, null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
            if (np.diff(rank) <= 0).any():
                order = np.lexsort((pos, rank[doc]))
                values, doc, pos = values.take(pa.array(order)), doc[order], pos[order]
            coded = values.dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy()
            # A dictionary lists its tokens in the order they first appear in.
            first = np.nonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))[0]
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary, docs.take(pa.array(doc[first])), pa.array(pos[first].astype(np.int64)),
                 pa.array(np.bincount(codes).astype(np.int64))], ["token", "doc_id", "pos", "n"])

    return arrays.select("doc_id", "tokens").mapInArrow(run, f"token string, doc_id {arrays.schema['doc_id'].dataType.simpleString()}, pos long, n long")


def encode_arrays(arrays: DataFrame, vocab: DataFrame, how: str = "inner", stats: bool = False) -> DataFrame:
    """J1 for ``(doc_id, tokens)``: the encoded form of the module; ``stats`` adds occurrences and frequency.

    A token that the vocabulary does not have is left out (inner) or has a null id (left).
    """
    if how not in ("inner", "left"):
        raise ValueError("encode_arrays supports inner and left joins")
    spark = arrays.sparkSession
    extra = ["occurrences", "frequency"] if stats else []
    hot = hot_tokens(vocab.select(*dict.fromkeys(["token", "token_id", "occurrences", *extra])))
    by_id = hot.sort_by("token_id")
    shared = spark.sparkContext.broadcast((hot.column("token").combine_chunks(), hot.column("token_id").to_numpy(),
                                           [by_id.column(c).to_numpy() for c in ("token_id", *extra)]))

    def look_up(batches):
        tokens, token_ids, _ = shared.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            column = b.column("tokens")
            values, at = column.flatten(), _offsets(column)
            place = pc.index_in(values, value_set=tokens)
            known = place.is_valid().to_numpy(zero_copy_only=False)
            ids = np.full(len(values), NO_ID)
            ids[known] = token_ids[pc.drop_null(place).to_numpy()]
            cold = np.nonzero(~known)[0]
            first = np.searchsorted(cold, at)
            pos = cold - np.repeat(at[:-1], np.diff(first))
            rest = pa.StructArray.from_arrays([pa.array(pos.astype(np.int64)), values.take(pa.array(cold))], ["pos", "token"])
            rows = pa.array(np.arange(row, row + b.num_rows, dtype=np.int64))
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows, _lists(at, pa.array(ids)), _lists(first, rest)],
                                             ["doc_id", "row", "ids", "rest"])

    # Stored, as both the documents and their rare tokens are read from it.
    looked_up = materialize(arrays.select("doc_id", "tokens").mapInArrow(
        look_up, "doc_id long, row long, ids array<long>, rest array<struct<pos: long, token: string>>"))
    rare = looked_up.select("doc_id", "row", F.inline("rest")).join(vocab.select("token", "token_id", *extra), "token")
    none = lambda t: F.lit(None).cast(t)
    found = F.struct("row", "pos", "token_id", *extra)
    found_type = "struct<row: bigint, pos: bigint, token_id: bigint" + (", occurrences: bigint, frequency: double>" if stats else ">")
    both = (looked_up.select("doc_id", F.struct("row", "ids").alias("part"), none(found_type).alias("found"))
            .unionByName(rare.select("doc_id", none("struct<row: bigint, ids: array<bigint>>").alias("part"), found.cast(found_type).alias("found"))))
    # Few, heavy rows follow: they stay spread over the configured partitions (see samples.id_arrays).
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = both.repartition(n, "doc_id").groupBy("doc_id").agg(F.collect_list("part").alias("parts"), F.collect_list("found").alias("found"))

    def fill(batches):
        hot_ids, *hot_stats = shared.value[2]
        for b in batches:
            docs = _offsets(b.column("parts"))                  # parts of a document
            part, found = b.column("parts").flatten(), b.column("found").flatten()
            lists = part.field("ids")
            ids, at = lists.flatten().to_numpy(zero_copy_only=False).copy(), _offsets(lists)
            known = ids != NO_ID
            spots = np.searchsorted(hot_ids, ids[known]) if stats else None
            columns = [ids]
            for values in hot_stats:
                column = np.zeros(len(ids), values.dtype)
                column[known] = values[spots]
                columns.append(column)
            if len(found):
                rows = part.field("row").to_numpy()
                order = np.argsort(rows)
                which = order[np.searchsorted(rows, found.field("row").to_numpy(), sorter=order)]
                spot = at[which] + found.field("pos").to_numpy()
                for column, name in zip(columns, ["token_id", *extra], strict=True):
                    column[spot] = found.field(name).to_numpy()
            ends = at[docs]                                      # ids of a document
            lengths = np.diff(ends)
            missing = ids == NO_ID
            odd = np.diff(docs) != 1
            if how == "inner":
                before = np.concatenate([[0], np.cumsum(missing)])
                odd |= before[ends[1:]] > before[ends[:-1]]
            pos_lists = [None] * len(lengths)
            if odd.any():
                pos = np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))
                keep = ~missing if how == "inner" else np.ones(len(ids), bool)
                pieces, lengths = [], lengths.copy()
                for d, (a, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    own = np.arange(a, e)
                    if odd[d]:
                        own = own[keep[a:e]]
                        own = own[np.lexsort((ids[own], pos[own]))]
                        lengths[d], pos_lists[d] = len(own), pos[own]
                    pieces.append(own)
                take = np.concatenate(pieces)
                columns, missing = [c[take] for c in columns], missing[take]
                ends = np.concatenate([[0], np.cumsum(lengths)])
            out = [_lists(ends, pa.array(c, mask=missing)) for c in columns]
            batch = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pos_lists, pa.list_(pa.int64())), *out],
                                               ["doc_id", "pos", "ids", *extra])
            # A document without any token that has an id is no row.
            yield batch if lengths.all() else batch.filter(pa.array(lengths > 0))

    types = "".join(f", {c} array<{t}>" for c, t in (("occurrences", "long"), ("frequency", "double")) if stats)
    return grouped.mapInArrow(fill, f"doc_id long, pos array<long>, ids array<long>{types}")


def as_rows(encoded: DataFrame) -> DataFrame:
    """``doc_id, pos, token_id`` for every id of the encoded form."""
    rows = encoded.select("doc_id", F.col("pos").alias("__at"), F.posexplode("ids").alias("__i", "token_id"))
    return rows.select("doc_id", F.coalesce(F.get("__at", F.col("__i")), F.col("__i").cast("long")).alias("pos"), "token_id")


def sampling_flags(encoded: DataFrame, min_occurrences: int, subsample: float, seed: int, epoch: int) -> DataFrame:
    """P7 + W7 for the encoded form: adds ``keep``, the flags of ``samples.with_sampling_flag``.

    A position is drawn only if its token's keep probability is below one.
    """
    def run(batches):
        for b in batches:
            lists, at = b.column("ids"), _offsets(b.column("ids"))
            occurrences = b.column("occurrences").flatten().to_numpy(zero_copy_only=False)
            f = b.column("frequency").flatten().to_numpy(zero_copy_only=False)
            p = np.clip(np.sqrt(f / subsample + 1.0) * (subsample / f), 0.0, 1.0)
            keep = occurrences >= min_occurrences
            drawn = np.nonzero(keep & (p < 1.0))[0]
            first = np.searchsorted(drawn, at).tolist()
            u = np.empty(len(drawn), np.uint32)
            docs, places = b.column("doc_id").to_pylist(), b.column("pos")
            for d, (a, e) in enumerate(zip(first[:-1], first[1:], strict=True)):
                if a == e:
                    continue
                pos = drawn[a:e] - at[d]
                if places[d].is_valid:
                    pos = places[d].values.to_numpy()[pos]
                # concat_ws leaves a null doc_id out.
                start = hashlib.md5(f"{seed}|{epoch}|".encode() + (b"" if docs[d] is None else b"%d|" % docs[d]))
                for k, i in enumerate(pos.tolist(), a):
                    h = start.copy()
                    h.update(b"%d" % i)
                    u[k] = int.from_bytes(h.digest()[:4], "big")
            keep[drawn] = u / 4294967296.0 < p[drawn]
            columns = [b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, _lists(at, pa.array(keep))], [*b.schema.names, "keep"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, schema + ", keep array<boolean>")


def chunks(encoded: DataFrame, before: int, after: int, with_keep: bool, chunk: int) -> DataFrame:
    """``samples.id_chunks`` of the encoded form: slices of each document, in the task that has it."""
    pos, n, k = F.col("pos"), F.size("ids").cast("long"), F.col("chunk")
    last = F.coalesce(F.get(pos, F.size(pos) - 1), n - 1)
    listed = encoded.filter(n > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / F.lit(chunk)))).alias("chunk"))
    low, high = k * chunk - before, (k + 1) * chunk + after
    start = F.when(pos.isNull(), F.greatest(low, F.lit(0))).otherwise(F.size(F.filter(pos, lambda p: p < low)).cast("long"))
    end = F.when(pos.isNull(), F.least(high, n)).otherwise(F.size(F.filter(pos, lambda p: p < high)).cast("long"))
    cut = listed.withColumn("__start", start).withColumn("__size", (end - F.col("__start")).cast("int"))
    begin = (F.col("__start") + 1).cast("int")
    kept = [F.slice("keep", begin, F.col("__size")).alias("keep")] if with_keep else []
    # A chunk with nothing of its own or behind it is left out, as in the row form.
    trailing = F.get(pos, (F.col("__start") + F.col("__size") - 1).cast("int")) >= k * chunk
    return cut.filter(pos.isNull() | ((F.col("__size") > 0) & trailing)).select(
        "doc_id", "chunk", F.coalesce(F.get(pos, F.col("__start").cast("int")), F.col("__start")).alias("first"),
        F.lit(chunk).alias("size"), F.slice("ids", begin, F.col("__size")).alias("ids"), *kept)
