"""RET13 with the choice of different hits, against plain loops over small tables."""

import random
import re

import numpy as np

from casegrid.functions import patterns as P
from casegrid.operators import answerset, retrieval
from casegrid.plans import case_queries

MODES = ["free_qa", "timeline", "expert_analysis", "general_knowledge", None, "made up", "causation"]


def plain(asked, vectors, points, chunks):
    out = {}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    lexical = sorted(((-sum(t.lower() in c["text"].lower() for t in P.IMAGING_TERMS) / 4, c["chunk_index"], c["chunk_id"]) for c in chunks.values()))
    lexical = [(-s, c) for s, _, c in lexical if s < 0][:24]
    by_id = {c["chunk_id"]: c for c in chunks.values()}
    for q, mode, text, top in asked:
        mode = mode if mode in P.MODES or mode == P.NO_RETRIEVAL_MODE else "free_qa"
        if mode == P.NO_RETRIEVAL_MODE:
            continue
        kind, least_hits, threshold, _ = P.MODES[mode]
        hits = max(top or 0, least_hits)
        k = max(8, min(20, hits // 3)) if kind else hits
        merged = {}
        for facet in range(len(P.FACETS[kind]) + 1 if kind else 1):
            if (q, facet) not in vectors:
                continue
            scored = sorted((-round(float(unit(vectors[q, facet]) @ unit(v)), 6), i) for i, v in points.items())[: 2 * k]
            found = [(-s, i) for s, i in scored if -s >= threshold]
            if len(found) > k:
                found = [found[j] for j in retrieval.mmr_order(np.array([s for s, _ in found]), [chunks[i]["text"] for _, i in found], k)]
            if not kind:
                out[q] = [(chunks[i]["chunk_id"], s) for s, i in found]
            for s, i in found:
                merged[chunks[i]["chunk_id"]] = max(s, merged.get(chunks[i]["chunk_id"], -2))
        if not kind:
            continue
        if "mri" in text.lower():
            for s, c in lexical[: max(12, min(24, hits))]:
                merged[c] = max(merged.get(c, -2), s, 0.95 if by_id[c]["document_type"] == "radiology_report" else 0.84)
        ranked, prints = [], set()
        for s, c in sorted((-s, c) for c, s in merged.items()):
            row = by_id[c]
            words = " ".join(row["text"].lower().split())
            mark = ("radiology", row["author"]) if row["document_type"] == "radiology_report" else (row["doc_id"], words) if row["doc_id"] and words else ("own", c)
            if mark not in prints:
                prints.add(mark)
                ranked.append((c, -s))
        lead, seen = [], set()
        for c, s in ranked:
            if by_id[c]["doc_id"] and by_id[c]["doc_id"] not in seen:
                seen.add(by_id[c]["doc_id"])
                lead.append((c, s))
        out[q] = (lead + [x for x in ranked if x not in lead])[:hits]
    return out


def test_against_plain_loops(spark):
    rng = random.Random(11)
    vec = lambda: [rng.gauss(0.3, 1) for _ in range(6)]
    points = {i: vec() for i in range(150)}
    words = "pain knee scan shoulder review acute".split()
    chunks = {
        i: {"item_id": i, "chunk_id": f"c{i}", "chunk_index": i % 7, "doc_id": f"d{i % 23}" if i % 5 else None, "document_type": "radiology_report" if i % 6 == 0 else "letter", "author": f"a{i % 9}", "text": " ".join(rng.choice(words) for _ in range(rng.randrange(6))) + (" Conclusion: x" if i % 31 == 0 else "")}
        for i in range(150)
    }
    asked = [(q, MODES[q % 7], "and the MRI?" if q % 2 else "what else?", [None, 12, 60][q % 3]) for q in range(14)]
    vectors = {(q, f): vec() for q in range(14) for f in range(9) if (q, f) != (2, 3)}
    got = answerset.answer_set(
        spark.createDataFrame(asked, "query_id bigint, mode string, text string, top_k int"),
        spark.createDataFrame([(q, f, v) for (q, f), v in vectors.items()], "query_id bigint, facet_no int, query_vector array<double>"),
        spark.createDataFrame(list(points.items()), "item_id bigint, vector array<double>"),
        spark.createDataFrame([(c["item_id"], c["chunk_id"], c["chunk_index"], c["doc_id"], c["document_type"], c["author"], None, c["text"]) for c in chunks.values()], "item_id bigint, chunk_id string, chunk_index int, doc_id string, document_type string, author string, date_extracted date, text string"),
    )
    held = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        held.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 6)))
    want = {q: [(c, round(s, 6)) for c, s in rows] for q, rows in plain(asked, vectors, points, chunks).items()}
    assert held == want and set(held) == {q for q in range(14) if q % 7 != 3}


def test_searches_of_a_mode(spark):
    asked = spark.createDataFrame([(1, "judge_analysis", "why", 90), (2, None, "why", None), (3, "timeline", "when", 3), (4, "general_knowledge", "?", 5)], "query_id bigint, mode string, text string, top_k int")
    rows = answerset.subqueries(asked).collect()
    by = lambda q: [(r["facet_no"], r["k"], r["subquery"]) for r in sorted(rows, key=lambda r: r["facet_no"]) if r["query_id"] == q]
    assert len(by(1)) == 9 and by(1)[0] == (0, 20, "why") and by(1)[1] == (1, 20, "why\nEvidence focus: " + P.FACETS["judge"][0])
    assert [x[:2] for x in by(2)] == [(0, 8), (1, 8), (2, 8)] and by(3) == [(0, 50, "when")] and by(4) == []


def test_logits_are_not_made_for_every_pair(spark, sf_dir):
    """Logits by chunk hold for every question; the query has no product of questions and chunks."""
    hits = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.4), (1, "b", 0.3)], "query_id bigint, chunk_id string, score double")
    by_chunk = spark.createDataFrame([("b", 0.0)], "chunk_id string, logit double")
    both = lambda logits: {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in retrieval.rerank(hits, logits).collect()}
    assert both(by_chunk) == {(1, "a", 0.5, 1), (2, "a", 0.4, 1), (1, "b", 0.5, 2)}
    assert both(by_chunk.selectExpr("1L AS query_id", "*")) == both(by_chunk)
    plan = case_queries.full_answer_set(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join (Cross|Inner)(, rightHint=.*|, leftHint=.*)?\n", plan)
