"""Recall of entity matching: every subject whose id is divisible by 20 against all subjects, with the full score."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnframe.llm import entities as e
from cairnframe.llm import queries as q
from cairnframe.session import table

DATA = "/root/testdata/sf0.01"


def _agreement(codes, steps, fields, model):
    gain, loss = np.zeros(len(fields)), np.zeros(len(fields))
    for j in range(len(fields)):
        v = codes[codes[:, j] > 0, j]
        if len(v):
            _, n = np.unique(v // (2 * steps[j]) if steps[j] else v, return_counts=True)
            u = min(0.5, max((n.astype(float) ** 2).sum() / n.sum() ** 2, 1e-6))
            gain[j], loss[j] = math.log(model.same / u), math.log((1 - model.same) / (1 - u))
    return gain, loss


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_recall_against_all_subjects(spark):
    got = {tuple(r) for r in q.p5_found(spark, DATA).collect()}
    rows, model = table(spark, DATA, "candidates").where("subject_id is not null"), e.Model()
    every = list(dict.fromkeys(f for fs in q.P5_FIELDS.values() for f in fs))
    codes = {r.subject_id: dict(r.codes) for r in e.attribute_codes(rows, table(spark, DATA, "ref_units"), every).collect()}
    known = rows.where(F.col("entity_type").isin(*q.P5_FIELDS) & F.col("domain").isNotNull()).groupBy("subject_id").agg(F.min("entity_type").alias("kind"), F.min(F.xxhash64("domain")).alias("source")).toPandas()
    forms = e.name_forms(rows, table(spark, DATA, "alias_candidates")).toPandas().groupby("subject_id")["form"].apply(set)
    wanted = set()
    for kind, fields in q.P5_FIELDS.items():
        mine = known[known.kind == kind]
        ids, sources, n = mine.subject_id.to_numpy(), mine.source.to_numpy(), len(mine)
        c = np.array([[codes.get(x, {}).get(every.index(f), 0) for f in fields] for x in ids])
        steps = np.array([e._steps(f) if f.kind in ("number", "degree") else 0 for f in fields])
        gain, loss = _agreement(c, steps, fields, model)
        bearers = Counter(f for x in ids for f in forms.get(x, ()))
        words = Counter(w for x in ids for w in {w for f in forms.get(x, ()) for w in f.split() if len(w) > 2})

        def names(x):
            return ";".join(sorted(f"{f}|{bearers[f]}|{min((words[w] for w in f.split() if len(w) > 2), default='')}" for f in forms.get(x, ()))) or None

        told = [names(x) for x in ids]
        for i in np.flatnonzero(ids % 20 == 0):
            score = np.where((c[i] > 0) & (c > 0), np.where(np.abs(c - c[i]) <= steps, gain, loss), 0).sum(1)
            # No name tells more than log(same_name · n).
            for j in np.flatnonzero((sources != sources[i]) & (score + math.log(model.same_name) >= 0)):
                if score[j] - math.log(n) + e.name_evidence(told[i], told[j], n, model) >= math.log(model.least / (1 - model.least)):
                    wanted.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    assert len(wanted) > 10 and len(wanted & got) >= 0.95 * len(wanted)
