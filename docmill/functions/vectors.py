"""Arrow-batch kernels for exact cosine top-k against a broadcast query block.

Used through ``DataFrame.mapInArrow``: each task scores its corpus batches
against the (size-checked) query block with one matrix product and keeps
only the per-query top-k, so the rows leaving a task are at most queries x k no
matter how big the corpus is or how many candidates tie. The final top-k is a
Spark window over those candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc



def as_matrix(list_array: pa.Array) -> np.ndarray:
    """ARRAY<FLOAT|DOUBLE> column of equal-length vectors -> float64 matrix."""
    list_array = list_array.combine_chunks() if isinstance(list_array, pa.ChunkedArray) else list_array
    n = len(list_array)
    if n == 0:
        return np.zeros((0, 0))
    flat = list_array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norms > 0, m / norms, np.nan)


def _sort_keys(columns) -> list[np.ndarray]:
    """Integer codes of Arrow columns that order like their values, NULL first."""
    codes = []
    for column in columns:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        ranks = pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
        codes.append(ranks.to_numpy(zero_copy_only=False).astype(np.int64))
    return codes


def first_k(qi: np.ndarray, dist: np.ndarray, keys: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the ``k`` first pairs of each query by (distance, keys): exactly
    min(k, pairs), whatever ties there are."""
    order = np.lexsort([*reversed(keys), dist, qi])
    q = qi[order]
    starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[place < k]


class Best:
    """The k nearest candidates per query among all batches of a task, ties by
    key: memory and output stay within queries x k rows. ``kth``: distance of each
    query's k-th so far (infinite below k); what is farther need not be added."""

    def __init__(self, k: int, keys: list[str], queries: int):
        self.k, self.keys, self.qi, self.dist, self.rows = k, keys, None, None, None
        self.kth = np.full(queries, np.inf)

    def add(self, qi: np.ndarray, dist: np.ndarray, rows: pa.Table) -> None:
        if not len(qi):
            return
        if self.qi is not None:
            qi, dist = np.concatenate([self.qi, qi]), np.concatenate([self.dist, dist])
            rows = pa.concat_tables([self.rows, rows])
        keep = first_k(qi, dist, _sort_keys([rows.column(c) for c in self.keys]), self.k)
        self.qi, self.dist, self.rows = qi[keep], dist[keep], rows.take(pa.array(keep))
        last = np.flatnonzero(np.r_[np.diff(self.qi) != 0, True])
        full = last[np.diff(np.r_[-1, last]) == self.k]
        self.kth[self.qi[full]] = self.dist[full]


def near_pairs(queries: np.ndarray, corpus: np.ndarray, kth: np.ndarray, k: int, decimals: int = 6):
    """(query, row of corpus, rounded distance) of the pairs of unit vectors that may be
    among a query's k nearest: none farther than ``kth``, nor than its k-th in ``corpus``.
    Without a direction (NaN) there is no pair."""
    similar = queries @ corpus.T                                            # (Q, B)
    least = 1.0 - kth - 10.0 ** -decimals
    new = np.flatnonzero(np.isinf(kth))
    if len(new) and similar.shape[1] > k:
        some = similar if len(new) == len(kth) else similar[new]
        some = np.where(np.isnan(some), -np.inf, some)
        at = some.shape[1] - k
        least[new] = np.partition(some, at, axis=1)[:, at] - 10.0 ** -decimals
    qi, ci = np.nonzero(similar >= least[:, None])
    return qi, ci, np.round(1.0 - similar[qi, ci], decimals) + 0.0  # no -0.0


def topk_kernel(query_ids: np.ndarray, query_unit: np.ndarray, k: int, id_col: str = "cid",
                vec_col: str = "vec", carry=(), decimals: int = 6, block_cells: int = 4_000_000):
    """mapInArrow function for one broadcast query block: exactly the k nearest
    vectors per query of the task, by (distance rounded to ``decimals``, key),
    with their ``carry`` columns."""
    columns = [id_col, *carry]
    rows_per_block = max(1, block_cells // max(1, len(query_ids)))

    def run(batches):
        best = Best(k, [id_col], len(query_ids))
        for whole in batches:
            for lo in range(0, whole.num_rows, rows_per_block):
                batch = whole.slice(lo, rows_per_block)
                corpus = unit_rows(as_matrix(batch.column(vec_col)))
                qi, ci, d = near_pairs(query_unit, corpus, best.kth, k, decimals)
                keep = first_k(qi, d, [c[ci] for c in _sort_keys([batch.column(id_col)])], k)
                rows = pa.Table.from_batches([batch.select(columns)])
                best.add(qi[keep], d[keep], rows.take(pa.array(ci[keep])))
        if best.qi is not None:
            kept = [best.rows.column(c).combine_chunks() for c in columns]
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[best.qi], pa.int64()), *kept, pa.array(best.dist, pa.float64())],
                names=["qid", "cid", *carry, "distance"])

    return run


def cell_kernel(query_unit: np.ndarray, cells: pa.ChunkedArray, kth: np.ndarray, k: int, carry=()):
    """mapInArrow function for vectors with cells (cid, ``carry``, u, cell): each unit query
    meets the vectors of its list of ``cells`` that aren't farther than its ``kth``. A task
    emits each query's k nearest, by (rounded distance, cid), as (_q, cid, carry, distance)."""
    flat = np.concatenate([c.flatten().to_numpy() for c in cells.chunks] or [np.zeros(0)]).astype(np.int64)
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in cells.chunks] or [np.zeros(0)]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    cell_of, asking = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order]

    def run(batches):
        best = Best(k, ["cid"], len(query_unit))
        best.kth = kth.copy()
        columns = ["cid", *carry]
        for batch in batches:
            u, cell = as_matrix(batch.column("u")), batch.column("cell").to_numpy()
            rows = np.argsort(cell, kind="stable")
            cuts = np.flatnonzero(np.diff(cell[rows])) + 1
            found = []
            for own in np.split(rows, cuts) if len(rows) else []:
                a, b = np.searchsorted(cell_of, [cell[own[0]], cell[own[0]] + 1])
                if a < b:
                    q = asking[a:b]
                    qi, ci, d = near_pairs(query_unit[q], u[own], best.kth[q], k)
                    found.append((q[qi], own[ci], d))
            if found:
                qi, ci, d = (np.concatenate(x) for x in zip(*found))
                keep = first_k(qi, d, [c[ci] for c in _sort_keys([batch.column("cid")])], k)
                best.add(qi[keep], d[keep], pa.Table.from_batches([batch.select(columns)]).take(pa.array(ci[keep])))
        if best.qi is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.qi), *[best.rows.column(c).combine_chunks() for c in columns], pa.array(best.dist, pa.float64())],
                names=["_q", *columns, "distance"])

    return run


def count_tokens(batch: pa.RecordBatch, tokens_col: str, others: list) -> pa.RecordBatch:
    """The ``others`` columns of a batch, and of its token lists the distinct terms,
    their counts and the sum of the squared counts."""
    toks = batch.column(tokens_col)
    flat, rows = toks.flatten(), pc.list_parent_indices(toks).to_numpy().astype(np.int64)
    enc = pc.dictionary_encode(flat)
    width = max(1, len(enc.dictionary))
    keys, tf = np.unique(rows * width + enc.indices.to_numpy().astype(np.int64), return_counts=True)
    at = np.searchsorted(keys, np.arange(batch.num_rows + 1) * width)
    offsets = pa.array(at, pa.int32())
    norm2 = np.diff(np.concatenate([[0], np.cumsum(tf.astype(np.int64) ** 2)])[at])
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in others],
         pa.ListArray.from_arrays(offsets, enc.dictionary.take(pa.array(keys % width))),
         pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64))), pa.array(norm2)],
        names=[*others, "terms", "tfs", "norm2"])


def pair_sums(cells: np.ndarray, weights: np.ndarray, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, summed weight) of the cells that occur. Sorting costs more per pair,
    a full array more per cell; the cheaper of the two is taken."""
    if len(cells) * 8 < n_cells:
        found, place = np.unique(cells, return_inverse=True)
        return found, np.bincount(place, weights=weights, minlength=len(found))
    sums = np.bincount(cells, weights=weights, minlength=n_cells)
    found = np.flatnonzero(sums)
    return found, sums[found]


def lexical_kernel(vocab: list, term_ptr: np.ndarray, term_q: np.ndarray, term_w: np.ndarray,
                   q_norm: np.ndarray, k: int, key_cols: list, carried_cols: list = (), tokens_col: str = "tokens",
                   decimals: int = 6, fanout_block: int = 4_000_000, query_keys=None):
    """mapInArrow function: term-count cosine of each chunk against a
    broadcast query block.

    The query block is a term-indexed sparse matrix: for term ``t`` the
    queries ``term_q[term_ptr[t]:term_ptr[t+1]]`` hold it with counts
    ``term_w[...]``; ``q_norm`` is sqrt of each query's summed squared counts.
    Chunk term counts and norms come from Arrow dictionary encoding and one
    sorted-unique pass; each (chunk, term) pair is expanded only to the queries
    that hold the term, and only pairs with a common term are scored, in blocks
    of about ``fanout_block`` expansions. Dot products are exact integers. A task
    emits exactly its min(k, candidates) nearest chunks per query, by (distance
    rounded to ``decimals``, ``key_cols``), with ``key_cols`` and
    ``carried_cols``. With ``query_keys`` (Arrow table, row i = query i) the key
    columns are emitted instead of the query index ``_q``.
    """
    import pandas as pd

    index = pd.Index(vocab)
    nq = len(q_norm)
    columns = list(key_cols) + [c for c in carried_cols if c not in key_cols]
    rows_per_block = max(1, min(4096, fanout_block // max(1, nq)))

    def run(batches):
        best = Best(k, list(key_cols), nq)
        for batch in batches:
            table = pa.Table.from_batches([batch.select(columns)])
            for lo in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(lo, rows_per_block)
                for qi, ci, dist in score(part):
                    near = dist <= best.kth[qi]
                    qi, ci, dist = qi[near], ci[near], dist[near]
                    keys = _sort_keys([part.column(c) for c in key_cols])
                    keep = first_k(qi, dist, [c[ci] for c in keys], k)
                    best.add(qi[keep], dist[keep], table.take(pa.array(ci[keep] + lo)))
        if best.qi is None:
            return
        if query_keys is None:
            q_cols, q_names = [pa.array(best.qi.astype(np.int32))], ["_q"]
        else:
            qt = pa.array(best.qi)
            q_cols = [query_keys.column(c).take(qt).combine_chunks() for c in query_keys.column_names]
            q_names = list(query_keys.column_names)
        cols = [best.rows.column(c).combine_chunks() for c in columns]
        yield pa.RecordBatch.from_arrays(q_cols + cols + [pa.array(best.dist, pa.float64())],
                                         names=q_names + columns + ["distance"])

    def score(part):
        """(query, row of part, rounded distance) of the pairs with a common term."""
        n = part.num_rows
        toks = part.column(tokens_col)
        flat = toks.flatten()
        if n == 0 or len(flat) == 0:
            return
        rows = pc.list_parent_indices(toks).to_numpy().astype(np.int64)
        # hash tokens in Arrow (C++); only the block dictionary becomes Python
        enc = pc.dictionary_encode(flat)
        if isinstance(enc, pa.ChunkedArray):
            enc = enc.combine_chunks()
        codes = enc.indices.to_numpy().astype(np.int64)
        uniq = enc.dictionary.to_numpy(zero_copy_only=False)
        nu = len(uniq)
        ukey, tf = np.unique(rows * nu + codes, return_counts=True)
        r_u, c_u = ukey // nu, ukey % nu
        c2 = np.bincount(r_u, weights=tf.astype(np.float64) ** 2, minlength=n)
        qv = index.get_indexer(uniq)[c_u]
        sel = qv >= 0
        r_s, v_s, tf_s = r_u[sel], qv[sel], tf[sel].astype(np.float64)
        fan = term_ptr[v_s + 1] - term_ptr[v_s]
        cum = np.cumsum(fan)
        lo = 0
        while lo < len(v_s):  # whole rows, about fanout_block expansions
            base = cum[lo - 1] if lo else 0
            hi = int(np.searchsorted(cum, base + fanout_block, side="right"))
            hi = int(np.searchsorted(r_s, r_s[max(hi - 1, lo)], side="right")) if hi < len(v_s) else len(v_s)
            f = fan[lo:hi]
            total = int(f.sum())
            if total:
                firsts = np.repeat(term_ptr[v_s[lo:hi]], f)
                slot = firsts + np.arange(total) - np.repeat(np.cumsum(f) - f, f)
                row0, span = int(r_s[lo]), int(r_s[hi - 1]) - int(r_s[lo]) + 1
                cells, dots = pair_sums(np.repeat(r_s[lo:hi] - row0, f) * nq + term_q[slot],
                                        term_w[slot] * np.repeat(tf_s[lo:hi], f), span * nq)
                qi, ci = cells % nq, cells // nq + row0
                yield qi, ci, np.round(1.0 - dots / (q_norm[qi] * np.sqrt(c2[ci])), decimals)
            lo = hi

    return run


def coded_bags(vocab: list, keep: list[str], tokens_col: str = "tokens"):
    """mapInArrow function: the ``keep`` columns of each row, the numbers of its tokens in
    ``vocab`` (distinct ones), their counts, and the summed squared counts of all tokens."""
    import pandas as pd

    index = pd.Index(vocab, dtype=object)

    def run(batches):
        for batch in batches:
            toks, n = batch.column(tokens_col), batch.num_rows
            rows = pc.list_parent_indices(toks).to_numpy().astype(np.int64)
            enc = pc.dictionary_encode(toks.flatten())
            uniq = enc.dictionary.to_numpy(zero_copy_only=False)
            cells, tf = np.unique(rows * max(1, len(uniq)) + enc.indices.to_numpy(), return_counts=True)
            row, code = cells // max(1, len(uniq)), index.get_indexer(uniq)[cells % max(1, len(uniq))]
            norm2 = np.bincount(row, weights=tf.astype(np.float64) ** 2, minlength=n).astype(np.int64)
            row, code, tf = (x[code >= 0] for x in (row, code, tf))
            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (code, tf)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *lists, pa.array(norm2)],
                                             names=[*keep, "codes", "tfs", "norm2"])

    return run


#: Most terms of a query block that are scored by matrix products, cells of a product.
DENSE_TERMS, PRODUCT_CELLS = 128, 4_000_000


def coded_kernel(term_ptr: np.ndarray, term_q: np.ndarray, term_tf: np.ndarray, query_ids: np.ndarray, k: int,
                 columns: list[str], key_cols: list[str], decimals: int = 6):
    """mapInArrow function over :func:`coded_bags`: exactly the task's k nearest rows per
    query of a block, as :func:`lexical_kernel` has them (term t is held by the queries
    ``term_q[term_ptr[t]:term_ptr[t + 1]]``, ``term_tf`` times).

    The block's commonest terms make a matrix; the other terms' products are added to the
    cells where they meet. The sums (in single precision while all dot products are far
    below what it can tell apart) only choose the cells that may be among the k nearest; a
    chosen cell's dot product is the integer next to it, which is exact."""
    nq, nt = len(query_ids), len(term_ptr) - 1
    held = np.diff(term_ptr)
    common = np.argsort(-held, kind="stable")[:DENSE_TERMS]
    common = common[held[common] > 0]
    column = np.full(nt, -1, dtype=np.int64)
    column[common] = np.arange(len(common))
    term = np.repeat(np.arange(nt), held)
    q_norm = np.sqrt(np.bincount(term_q, weights=term_tf.astype(np.float64) ** 2, minlength=nq))
    matrix = np.zeros((len(common), nq), dtype=np.float32)
    matrix[column[term[column[term] >= 0]], term_q[column[term] >= 0]] = term_tf[column[term] >= 0]
    rows_per_block = max(1, min(4096, PRODUCT_CELLS // max(1, nq)))

    def sums(rows, codes, tfs, norm):
        """Cosine times the query's norm of each row (chunk) and query."""
        kind = np.float32 if q_norm.max() * norm.max() < 10_000 else np.float64
        share = tfs / norm[rows]
        dense = column[codes] >= 0
        left = np.zeros((len(norm), len(common)), dtype=kind)
        left[rows[dense], column[codes[dense]]] = share[dense]
        out = left @ matrix.astype(kind, copy=False)
        r, c, x = rows[~dense], codes[~dense], share[~dense]
        fan = held[c]
        slot = np.repeat(term_ptr[c] - np.cumsum(fan) + fan, fan) + np.arange(int(fan.sum()))
        np.add.at(out.reshape(-1), np.repeat(r, fan) * nq + term_q[slot],
                  (np.repeat(x, fan) * term_tf[slot]).astype(kind))
        return out

    def run(batches):
        best, pending = Best(k, key_cols, nq), []

        def flush():
            if pending:
                best.add(np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending]),
                         pa.concat_tables([p[2] for p in pending]))
                pending.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(lo, rows_per_block)
                rows = pc.list_parent_indices(part.column("codes")).to_numpy().astype(np.int64)
                codes, tfs = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("codes", "tfs"))
                norm = np.sqrt(part.column("norm2").to_numpy().astype(np.float64))
                near = sums(rows, codes, tfs, norm)
                least = 1.0 - best.kth - 10.0 ** -decimals
                new = np.flatnonzero(np.isinf(best.kth))
                if len(new) and len(near) > k:
                    at = len(near) - k
                    least[new] = np.partition(near if len(new) == nq else near[:, new], at, axis=0)[at] / q_norm[new] \
                        - 10.0 ** -decimals
                # room for single precision; without a common term there is no pair
                least = np.maximum((least - 1e-4) * q_norm, 1e-30).astype(near.dtype)
                cells = np.flatnonzero(near >= least)
                qi, ci = cells % nq, cells // nq
                dots = np.rint(near.reshape(-1)[cells].astype(np.float64) * norm[ci])
                dist = np.round(1.0 - dots / (q_norm[qi] * norm[ci]), decimals)
                ok = dist <= best.kth[qi]
                qi, ci, dist = qi[ok], ci[ok], dist[ok]
                keys = _sort_keys([part.column(c) for c in key_cols])
                keep = first_k(qi, dist, [c[ci] for c in keys], k)
                pending.append((qi[keep], dist[keep], pa.Table.from_batches([part.select(columns)]).take(pa.array(ci[keep]))))
                if sum(len(p[0]) for p in pending) * 4 > nq * k:
                    flush()
        flush()
        if best.qi is not None:
            kept = [best.rows.column(c).combine_chunks() for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[best.qi], pa.int64()), *kept, pa.array(best.dist, pa.float64())],
                                             names=["qid", *columns, "distance"])

    return run
