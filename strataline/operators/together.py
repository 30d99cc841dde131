"""Judging documents whose leaves stand together: alignment, both passes and their sums where a document lies.

What ``judge`` says of leaf tables with joins, each of which moves all leaves, is said here of whole documents: rows are
moved once, by document, before leaves are made of them. A worker holds the documents of some ten thousand rows as
arrays of numbers; texts are numbers of a list of different texts, so the normal form and the comparison of a text are
made once for all its leaves. One document is never split; one with very many elements is judged run by run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import text

#: Rows held at once at least, and rows of a batch given back.
HELD, ROWS = 30_000, 50_000
#: Pairs of equal leaves held at once; more are counted by truth elements, one after the other.
PAIRS = 5_000_000
STATUS = ["correct", "incorrect", "not_extracted"]
KINDS = ["false_positive", "partial_match", "wrong_value"]


@dataclass
class Side:
    """Leaves: place of the document, place of the run (0 in the truth), idx (-1 outside repeated groups), path, field number, text."""

    doc: np.ndarray
    run: np.ndarray
    idx: np.ndarray
    rel: np.ndarray
    fno: np.ndarray
    value: np.ndarray


@dataclass
class Leaves:
    """Whole documents. ``docs``: their keys, ``runs``: names of the runs, ``rels``: paths, ``texts``: texts by number, null allowed."""

    docs: pa.Array
    runs: list[tuple[str, ...]]
    rels: list[str]
    texts: pa.Array
    truth: Side
    pred: Side


def field_of(idx: int, rel: str, root: str = "order", array: str = "lines") -> str:
    return f"{root}.{rel}" if idx < 0 else f"{root}.{array}[{idx}].{rel}"


def label_of(field: str) -> str:
    return re.sub(r"\.+$", "", re.sub(r"\[\d+\]\.?", ".", field))


def parts_of(field: str) -> tuple[str, str, str]:
    """(section, top section, label) of a field."""
    parts = re.split(r"\.|\[", field)
    return ".".join(parts[:2]), parts[0], label_of(field)


def _norms(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """(number of the normal form by number of the text, the normal forms); the empty form has number 0."""
    texts = pc.fill_null(texts, "")
    odd = np.flatnonzero(pc.match_substring_regex(texts, r"[^0-9A-Za-z_./+*%-]").to_numpy(zero_copy_only=False))
    level = pa.array([text.levelled(x) for x in texts.take(pa.array(odd)).to_pylist()], pa.string())
    at = np.arange(len(texts))
    at[odd] = len(texts) + np.arange(len(odd))
    forms = pa.concat_arrays([pa.array([""], pa.string()), pa.concat_arrays([texts, level]).take(pa.array(at))]).dictionary_encode()
    return forms.indices.to_numpy()[1:].astype(np.int64), forms.dictionary.to_pylist()


def _starts(doc: np.ndarray, idx: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number of places) of the elements of each of ``n`` groups, one place for every idx up to the largest."""
    size = np.zeros(n, np.int64)
    np.maximum.at(size, doc, idx + 1)
    return np.cumsum(size) - size, size


def _left(keys: np.ndarray, size: int, needles: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Left join of ``needles`` (-1 matches nothing) with ``keys``: (rows of needles, or None for each once in order; rows of keys, -1 for none)."""
    table = np.full(size + 1, -1, np.int32)
    mine = np.arange(len(keys), dtype=np.int32)
    table[keys] = mine
    if (table[keys] == mine).all():
        return None, table[needles].astype(np.int64)
    order = np.argsort(keys, kind="stable")
    first = np.searchsorted(keys[order], needles, "left")
    n = np.searchsorted(keys[order], needles, "right") - first
    rows = np.repeat(np.arange(len(needles)), np.maximum(n, 1))
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(np.maximum(n, 1)) - np.maximum(n, 1), np.maximum(n, 1))
    return rows, np.where(n[rows] > 0, order[np.minimum(first[rows] + nth, len(order) - 1)], -1)


class Judged:
    """What the operators ask of some whole documents; everything is worked out when it is asked for."""

    def __init__(self, leaves: Leaves):
        self.all = leaves
        self.norm, self.forms = _norms(leaves.texts)
        t, p = leaves.truth, leaves.pred
        self.n_runs, self.n_rel = len(leaves.runs), len(leaves.rels)
        self.tn, self.pn = self.norm[t.value], self.norm[p.value]
        self.group = p.doc * self.n_runs + p.run
        docs = len(leaves.docs)
        self.t_first, self.t_size = _starts(t.doc, t.idx, docs)
        self.p_first, self.p_size = _starts(self.group, p.idx, docs * self.n_runs)
        self.elements, self.places = int(self.t_size.sum()), int(self.p_size.sum())

    def scores(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(group, truth idx, place of the predicted element, score), in blocks of whole truth elements in their order."""
        t, p = self.all.truth, self.all.pred
        ts, ps = np.flatnonzero((t.idx >= 0) & (self.tn > 0)), np.flatnonzero((p.idx >= 0) & (self.pn > 0))
        if not len(ts) or not len(ps):
            return
        forms = len(self.forms)
        pk = (p.doc[ps] * self.n_rel + p.rel[ps]) * forms + self.pn[ps]
        tk = (t.doc[ts] * self.n_rel + t.rel[ts]) * forms + self.tn[ts]
        order = np.argsort(tk)
        ts, tk = ts[order], tk[order]
        first = np.searchsorted(tk, pk, "left")
        new = np.append(True, tk[1:] != tk[:-1])
        run_of = np.cumsum(new) - 1
        length = np.diff(np.append(np.flatnonzero(new), len(tk)))
        hit = np.flatnonzero(tk[np.minimum(first, len(tk) - 1)] == pk)
        n = length[run_of[first[hit]]]
        place = self.p_first[self.group[ps[hit]]] + p.idx[ps[hit]]
        width = int(self.t_size.max())
        if n.sum() <= PAIRS:
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = np.repeat(place, n) * width + t.idx[ts[np.repeat(first[hit], n) + nth]]
            yield self._counted(key, width)
            return
        # by truth elements: how many predicted leaves each truth leaf meets says how many elements make a block
        by = np.argsort(pk[hit], kind="stable")
        pk, place = pk[hit][by], place[by]
        element = self.t_first[t.doc[ts]] + t.idx[ts]
        order = np.argsort(element, kind="stable")
        ts, tk, element = ts[order], tk[order], element[order]
        lo = np.searchsorted(pk, tk, "left")
        n = np.searchsorted(pk, tk, "right") - lo
        done, total = 0, np.cumsum(n)
        while done < len(ts):
            end = int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right"))
            end = int(np.searchsorted(element, element[max(end, done)] if end < len(ts) else element[-1] + 1, "left"))
            if end <= done:
                end = int(np.searchsorted(element, element[done], "right"))
            m = n[done:end]
            nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            key = place[np.repeat(lo[done:end], m) + nth] * width + np.repeat(t.idx[ts[done:end]], m)
            if len(key):
                yield self._counted(key, width)
            done = end

    def _counted(self, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pair, score = np.unique(key, return_counts=True)
        place, at = pair // width, pair % width
        return np.repeat(np.arange(len(self.p_size)), self.p_size)[place], at, place, score

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, truth idx, place of the predicted element): truth elements in order take the best free prediction, the lowest of equals."""
        used = np.zeros(self.places, bool)
        found: list[tuple[np.ndarray, ...]] = []
        for group, at, place, score in self.scores():
            # places of a group are in the order of its idx
            top = int(score.max(initial=0))
            if (int(at.max(initial=0)) + 1) * len(self.p_size) * (top + 1) * max(1, self.places) < 1 << 62:
                order = np.argsort(((at * len(self.p_size) + group) * (top + 1) + top - score) * self.places + place)
            else:
                order = np.lexsort((place, -score, group, at))
            group, at, place = group[order], at[order], place[order]
            for a, b in zip(s := np.flatnonzero(np.append(True, at[1:] != at[:-1])), np.append(s[1:], len(at)), strict=True):
                free = a + np.flatnonzero(~used[place[a:b]])
                if len(free):
                    best = free[np.append(True, group[free][1:] != group[free][:-1])]
                    used[place[best]] = True
                    found.append((group[best], at[best], place[best]))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3

    def truth_pass(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pass 1: (run, row of truth, row of pred or -1, status, kind or -1) of non-empty truth leaves in every run that has the document."""
        t, p = self.all.truth, self.all.pred
        there = np.zeros((len(self.all.docs), self.n_runs), bool)
        there[p.doc, p.run] = True
        full = np.flatnonzero(self.tn > 0)
        row, run = np.nonzero(there[t.doc[full]])
        row = full[row]
        group, at, place = self.matches()
        pair = np.full((self.elements + 1, self.n_runs), -1, np.int64)
        pair[self.t_first[group // self.n_runs] + at, group % self.n_runs] = place
        inner = t.idx[row] >= 0
        element = np.where(inner, self.t_first[t.doc[row]] + t.idx[row], self.elements)
        own = pair[element, run]
        needle = np.where(inner & (own < 0), -1, np.where(inner, own, self.places + t.doc[row] * self.n_runs + run) * self.n_rel + t.rel[row])
        key = np.where(p.idx >= 0, self.p_first[self.group] + p.idx, self.places + self.group) * self.n_rel + p.rel
        rows, hit = _left(key, (self.places + len(self.p_size)) * self.n_rel, needle)
        if rows is not None:
            row, run = row[rows], run[rows]
        a, b = self.tn[row], np.where(hit >= 0, self.pn[hit] if len(self.pn) else 0, 0)
        status = np.where(b == 0, 2, np.where(a == b, 0, 1))
        kind = np.full(len(row), -1, np.int64)
        differ = np.flatnonzero(status == 1)
        equal = self._numbers(a[differ], b[differ])
        status[differ[equal]] = 0
        wrong = differ[~equal]
        forms = self.forms
        kind[wrong] = [1 if y in x or x in y else 2 for x, y in zip([forms[i] for i in a[wrong].tolist()], [forms[i] for i in b[wrong].tolist()], strict=True)]
        return run, row, hit, status, kind

    def _numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        value = text.floats([self.forms[i] for i in both.tolist()])[at]
        return value[: len(a)] == value[len(a) :]

    def prediction_pass(self) -> np.ndarray:
        """Pass 2: rows of non-empty predicted leaves of known documents without a non-empty truth leaf at the same place."""
        t, p = self.all.truth, self.all.pred
        known = np.zeros(len(self.all.docs), bool)
        known[t.doc] = True
        table = np.zeros((self.elements + len(self.all.docs)) * self.n_rel + 1, bool)
        full = self.tn > 0
        table[(np.where(t.idx >= 0, self.t_first[t.doc] + t.idx, self.elements + t.doc) * self.n_rel + t.rel)[full]] = True
        key = np.where(p.idx < 0, self.elements + p.doc, self.t_first[p.doc] + p.idx) * self.n_rel + p.rel
        key[(p.idx >= 0) & (p.idx >= self.t_size[p.doc])] = -1
        return np.flatnonzero((self.pn > 0) & known[p.doc] & ~table[key])

    def fields(self, idx: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(number of the field of each leaf, the fields by number)."""
        code = (idx + 1) * self.n_rel + rel
        there = np.flatnonzero(np.bincount(code)) if len(code) else np.zeros(0, np.int64)
        number = np.zeros(int(there.max(initial=0)) + 1, np.int64)
        number[there] = np.arange(len(there))
        return number[code], [field_of(int(c) // self.n_rel - 1, self.all.rels[int(c) % self.n_rel]) for c in there]

    def labels(self) -> set[str]:
        """Labels of the predicted leaves."""
        code = np.flatnonzero(np.bincount((self.all.pred.idx < 0) * self.n_rel + self.all.pred.rel, minlength=2 * self.n_rel))
        return {label_of(field_of(-1 if c >= self.n_rel else 0, self.all.rels[int(c) % self.n_rel])) for c in code}

    def rows(self) -> dict[str, np.ndarray]:
        """All judged leaves of both passes: run, doc, pass, idx, rel, fno, status, kind, xml and llm (numbers of texts, -1 for the empty text)."""
        t, p = self.all.truth, self.all.pred
        run, a, b, status, kind = self.truth_pass()
        x = self.prediction_pass()
        n, both = len(x), lambda u, v: np.concatenate([u, v])
        said = np.where(status == 2, -1, p.value[b] if len(p.value) else -1)
        return {
            "run": both(run, p.run[x]), "doc": both(t.doc[a], p.doc[x]), "pass": both(np.ones(len(a), np.int64), np.full(n, 2)), "idx": both(t.idx[a], p.idx[x]), "rel": both(t.rel[a], p.rel[x]), "fno": both(t.fno[a], p.fno[x]),
            "status": both(status, np.ones(n, np.int64)), "kind": both(kind, np.zeros(n, np.int64)), "xml": both(t.value[a], np.full(n, -1)), "llm": both(said, p.value[x]),
        }


# --- columns ---------------------------------------------------------------------------------------------


def _named(codes: np.ndarray, names: list[str | None]) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(codes))


def _text(j: Judged, codes: np.ndarray) -> pa.Array:
    return pa.concat_arrays([j.all.texts, pa.array([""], pa.string())]).take(pa.array(np.where(codes < 0, len(j.all.texts), codes)))


def _ints(x: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.astype(np.int32), pa.int32(), mask=null)


def _run_columns(j: Judged, run: np.ndarray) -> list[pa.Array]:
    return [_named(run, [r[i] for r in j.all.runs]) for i in range(len(j.all.runs[0]))]


def _docs(j: Judged, doc: np.ndarray) -> pa.Array:
    return j.all.docs.take(pa.array(doc))


def _batches(columns: list[pa.Array], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    for at in range(0, len(whole), ROWS):
        yield whole.slice(at, ROWS)


#: Makes the leaves of whole documents: all runs at once, or some after the others, never a run twice.
Reader = Callable[[pa.Table], Iterator[Leaves]]


def over(df: DataFrame, read: Reader, schema: str, each: Callable[[Judged], Iterator[list[pa.Array]]], last: Callable[[], list[list[pa.Array]]] | None = None) -> DataFrame:
    """Rows of ``each`` from the documents of ``df``, whose rows stand together by its first column; ``last`` gives rows when a task is over."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for leaves in read(t):
                for columns in each(Judged(leaves)):
                    yield from _batches(columns, arrow)

        waiting = HELD
        for b in batches:
            if len(b):
                held.append(b)
            if sum(map(len, held)) < waiting:
                continue
            t = pa.Table.from_batches(held)
            doc = t.column(0).to_numpy()
            new = np.flatnonzero(doc[1:] != doc[:-1])[-1:] + 1  # the last document may go on in the next batch
            if len(new):
                n = int(new[0])
                yield from done(t.slice(0, n))
                held, waiting = t.slice(n).to_batches(), HELD
            else:
                waiting *= 2
        if held:
            yield from done(pa.Table.from_batches(held))
        for columns in last() if last else []:
            yield from _batches(columns, arrow)

    return df.mapInArrow(run, schema)


# --- operators -------------------------------------------------------------------------------------------


def _key(df: DataFrame) -> str:
    return f"doc {df.schema.fields[0].dataType.simpleString()}"


def _runs(run: list[str]) -> str:
    return ", ".join(f"{r} string" for r in run)


def overlap_scores(df: DataFrame, read: Reader, run: list[str]) -> DataFrame:
    """(doc, run, truth_idx, pred_idx, score), as ``align.overlap_scores`` has them."""

    def each(j: Judged) -> Iterator[list[pa.Array]]:
        for group, at, place, score in j.scores():
            yield [_docs(j, group // j.n_runs), *_run_columns(j, group % j.n_runs), _ints(at), _ints(place - j.p_first[group]), pa.array(score, pa.int64())]

    return over(df, read, f"{_key(df)}, {_runs(run)}, truth_idx int, pred_idx int, score bigint", each)


def alignment(df: DataFrame, read: Reader, run: list[str]) -> DataFrame:
    """(doc, run, truth_idx, pred_idx), as ``judge.alignment`` has them."""

    def each(j: Judged) -> Iterator[list[pa.Array]]:
        group, at, place = j.matches()
        yield [_docs(j, group // j.n_runs), *_run_columns(j, group % j.n_runs), _ints(at), _ints(place - j.p_first[group])]

    return over(df, read, f"{_key(df)}, {_runs(run)}, truth_idx int, pred_idx int", each)


def truth_pass(df: DataFrame, read: Reader, run: list[str]) -> DataFrame:
    """Pass 1: (run, doc, idx, rel, status, xml, llm_value)."""

    def each(j: Judged) -> Iterator[list[pa.Array]]:
        t, p = j.all.truth, j.all.pred
        r, a, b, status, _ = j.truth_pass()
        said = np.where(status == 2, -1, p.value[b] if len(p.value) else -1)
        yield [*_run_columns(j, r), _docs(j, t.doc[a]), _ints(t.idx[a], t.idx[a] < 0), _named(t.rel[a], j.all.rels), _named(status, STATUS), _text(j, t.value[a]), _text(j, said)]

    return over(df, read, f"{_runs(run)}, {_key(df)}, idx int, rel string, status string, xml string, llm_value string", each)


def prediction_pass(df: DataFrame, read: Reader, run: list[str]) -> DataFrame:
    """Pass 2: (run, doc, idx, rel, llm_value)."""

    def each(j: Judged) -> Iterator[list[pa.Array]]:
        p, x = j.all.pred, j.prediction_pass()
        yield [*_run_columns(j, p.run[x]), _docs(j, p.doc[x]), _ints(p.idx[x], p.idx[x] < 0), _named(p.rel[x], j.all.rels), _text(j, p.value[x])]

    return over(df, read, f"{_runs(run)}, {_key(df)}, idx int, rel string, llm_value string", each)


def labels(df: DataFrame, read: Reader) -> DataFrame:
    """(label) of all predicted leaves, each once."""
    seen: set[str] = set()

    def each(j: Judged) -> Iterator[list[pa.Array]]:
        new = sorted(j.labels() - seen)
        seen.update(new)
        yield [pa.array(new, pa.string())]

    return over(df, read, "label string", each).distinct()


def _unasked(j: Judged, status: np.ndarray, field: np.ndarray, names: list[str], seen: set[str]) -> tuple[np.ndarray, list[str | None]]:
    """(number by leaf, labels by number): the label of what is not extracted if no prediction so far has it, else none (number 0).

    What is predicted but not in the truth has the label of a prediction, so only what is not extracted is asked about.
    """
    seen |= j.labels()
    names_of = [parts_of(f)[2] for f in names]
    new = sorted(set(names_of) - seen)
    number = np.array([new.index(x) + 1 if x not in seen else 0 for x in names_of] or [0], np.int64)
    return np.where(status == 2, number[field] if len(field) else 0, 0), [None, *new]


def details(df: DataFrame, read: Reader, run: list[str], status: str | None = None) -> DataFrame:
    """All judged leaves, as ``judge.details`` has them with the labels of all predictions; or those of one status but "not_extracted"."""
    seen: set[str] = set()

    def each(j: Judged) -> Iterator[list[pa.Array]]:
        r = j.rows()
        if status is not None:
            keep = np.flatnonzero(r["status"] == STATUS.index(status))
            r = {k: v[keep] for k, v in r.items()}
        field, names = j.fields(r["idx"], r["rel"])
        parts = [parts_of(f) for f in names]
        own = [_named(*_unasked(j, r["status"], field, names, seen))] if status is None else []
        yield [
            *_run_columns(j, r["run"]), _docs(j, r["doc"]), _ints(r["pass"]), _ints(r["idx"], r["idx"] < 0), _ints(r["fno"]), _named(field, names), _named(field, [x[0] for x in parts]), _named(field, [x[1] for x in parts]),
            _named(r["status"], STATUS), _named(r["kind"] + 1, [None, *KINDS]), _text(j, r["xml"]), _text(j, r["llm"]), *own,
        ]

    schema = f"{_runs(run)}, {_key(df)}, pass int, idx int, fno int, field string, section string, top_section string, status string, error_type string, xml string, llm_value string"
    if status is not None:
        return over(df, read, schema, each)
    known = F.broadcast(labels(df, read).withColumn("__known", F.lit(True)))
    rows = over(df, read, f"{schema}, label string", each)
    return rows.join(known, "label", "left").where("label is null or __known").drop("label", "__known")


def file_counts(df: DataFrame, read: Reader, run: list[str]) -> DataFrame:
    """(run, doc, correct, incorrect, not_extracted) of the files with judged leaves; no file is moved for its sums."""
    seen: set[str] = set()

    def each(j: Judged) -> Iterator[list[pa.Array]]:
        r = j.rows()
        field, names = j.fields(r["idx"], r["rel"])
        number, unseen = _unasked(j, r["status"], field, names, seen)
        group = r["doc"] * j.n_runs + r["run"]
        n = len(j.p_size)
        there = np.flatnonzero(np.bincount(group, minlength=n))
        sums = [np.bincount(group[(r["status"] == s) & (number == 0)], minlength=n)[there] for s in range(3)]
        open_ = np.bincount(group[number > 0] * len(unseen) + number[number > 0], minlength=n * len(unseen)).reshape(n, -1)[there]
        at, what = np.nonzero(open_)
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(there)))])
        pair = pa.StructArray.from_arrays([_named(what, unseen), pa.array(open_[at, what], pa.int64())], names=["label", "n"])
        yield [*_run_columns(j, there % j.n_runs), _docs(j, there // j.n_runs), *(pa.array(x, pa.int64()) for x in sums), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair)]

    rows = over(df, read, f"{_runs(run)}, {_key(df)}, correct bigint, incorrect bigint, __n bigint, __asked array<struct<label:string,n:bigint>>", each)
    known = F.broadcast(labels(df, read).agg(F.collect_set("label").alias("__known")))
    more = F.aggregate("__asked", F.lit(0).cast("bigint"), lambda a, x: a + F.when(F.array_contains("__known", x["label"]), x["n"]).otherwise(0))
    rows = rows.crossJoin(known).select(*run, "doc", "correct", "incorrect", (F.col("__n") + more).alias("not_extracted"))
    return rows.where("correct + incorrect + not_extracted > 0")


#: A judged leaf that stands for its section.
EXAMPLE = ["doc", "pass", "idx", "fno", "field", "xml", "llm_value"]


def counts(df: DataFrame, read: Reader, run: list[str], retries: Callable[[np.ndarray], np.ndarray] | None = None, first: int = 0) -> DataFrame:
    """Sums of judged leaves by run, section, status and error kind, of documents, and the labels, from one reading.

    (run, section, top_section, status, error_type, label, retry_count, leaves, example): what is not extracted has a label;
    documents are rows of status "file" with ``retries`` of their keys as ``retry_count``; the labels of predictions are rows
    of status "label". With ``first`` there are rows of status "first", each an incorrect leaf: of every run and section the
    first ones of each task by document, pass, idx and field number. A task gives sums and these only.
    """
    sums: dict[tuple, int] = {}
    seen: set[str] = set()
    kept: dict[tuple, list[tuple]] = {}
    n = len(run)

    def each(j: Judged) -> Iterator[list[pa.Array]]:
        r = j.rows()
        field, names = j.fields(r["idx"], r["rel"])
        seen.update(j.labels())
        parts = [parts_of(f) for f in names]
        shape = (j.n_runs, max(1, len(names)), 3, 4)
        cell = np.bincount(np.ravel_multi_index((r["run"], field, r["status"], r["kind"] + 1), shape), minlength=np.prod(shape))
        for c in np.flatnonzero(cell):
            a, f, s, k = (int(x) for x in np.unravel_index(c, shape))
            section, top, label = parts[f]
            key = (*j.all.runs[a], section, top, STATUS[s], KINDS[k - 1] if k else None, label if s == 2 else None, None)
            sums[key] = sums.get(key, 0) + int(cell[c])
        if retries is not None:
            doc, at = np.divmod(np.flatnonzero(np.bincount(j.group, minlength=len(j.p_size))), j.n_runs)
            kinds, place = np.unique(retries(j.all.docs.to_numpy(zero_copy_only=False)[doc]), return_inverse=True)
            cell = np.bincount(at * len(kinds) + place)
            for c in np.flatnonzero(cell).tolist():
                key = (*j.all.runs[c // len(kinds)], None, None, "file", None, None, int(kinds[c % len(kinds)]))
                sums[key] = sums.get(key, 0) + int(cell[c])
        if first:
            note(j, r, field, names, parts)
        yield from ()

    def note(j: Judged, r: dict[str, np.ndarray], field: np.ndarray, names: list[str], parts: list[tuple]) -> None:
        wrong = np.flatnonzero(r["status"] == 1)
        sections = sorted({x[0] for x in parts})
        group = r["run"][wrong] * max(1, len(sections)) + np.array([sections.index(x[0]) for x in parts] or [0], np.int64)[field[wrong]]
        order = np.lexsort((r["fno"][wrong], r["idx"][wrong], r["pass"][wrong], r["doc"][wrong], group))
        wrong, group = wrong[order], group[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        nth = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        best = wrong[nth < first]
        cols = [_docs(j, r["doc"][best]).to_pylist(), *(r[k][best].tolist() for k in ("pass", "idx", "fno")), [names[i] for i in field[best].tolist()], _text(j, r["xml"][best]).to_pylist(), _text(j, r["llm"][best]).to_pylist()]
        for a, f, k, *x in zip(r["run"][best].tolist(), field[best].tolist(), r["kind"][best].tolist(), *cols, strict=True):
            section, top, _ = parts[f]
            kept.setdefault((*j.all.runs[a], section, top, "first", KINDS[k]), []).append(tuple(x))
            kept_of = kept[(*j.all.runs[a], section, top, "first", KINDS[k])]
            if len(kept_of) > 100 * first:
                kept_of.sort(key=lambda y: y[:4])
                del kept_of[first:]

    def last() -> list[list[pa.Array]]:
        blank = (None,) * n
        rows = [(*k, v, None) for k, v in sums.items()] + [(*blank, None, None, "label", None, x, None, 0, None) for x in sorted(seen)]
        for k, found in kept.items():
            found.sort(key=lambda y: y[:4])
            rows += [(*k, None, None, 1, dict(zip(EXAMPLE, (*x[:2], None if x[2] < 0 else x[2], *x[3:]), strict=True))) for x in found[:first]]
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return [[pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]]

    from pyspark.sql.pandas.types import to_arrow_type

    example = pa.struct([("doc", to_arrow_type(df.schema.fields[0].dataType)), ("pass", pa.int32()), ("idx", pa.int32()), ("fno", pa.int32()), ("field", pa.string()), ("xml", pa.string()), ("llm_value", pa.string())])
    kinds = [*[pa.string()] * (n + 5), pa.int64(), pa.int64(), example]
    fields = _key(df).replace("doc ", "doc:")
    return over(df, read, f"{_runs(run)}, section string, top_section string, status string, error_type string, label string, retry_count bigint, leaves bigint, example struct<{fields},pass:int,idx:int,fno:int,field:string,xml:string,llm_value:string>", each, last)
