"""The pipeline end to end: every stage against brute force over what the stage before it kept."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from cohortlens.llm import secret_scan, toxicity
from cohortlens.llm.shared import written
from tests.llm.test_secret_lexer import base_spans

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and after each one, as the pipeline writes and rereads them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs.collect())
    return out


def by_id(rows):
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_stages_return_the_columns_of_documents(steps):
    for rows in steps[:-1]:
        assert rows[0].__fields__ == steps[0][0].__fields__
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "secrets", "mix_sources"]


def test_toxicity_drops_what_the_operator_predicts(spark, steps):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    predicted = {r.doc_id: r.predicted for r in toxicity.document_toxicity(docs, labels).collect()}
    before, after = by_id(steps[0]), by_id(steps[1])
    assert set(after) == {i for i in before if not predicted[i]} and 0 < len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_one_document_of_each_group_of_near_duplicates_stays(steps):
    before, after = by_id(steps[1]), by_id(steps[2])
    sets = {}
    for i, r in before.items():
        w = SPACED.findall((r.text or "").translate(AZ))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(before)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert set(after) == {i for i in ids if find(i) == i} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_benchmark_passages_go(spark, steps):
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ALNUM.findall((r.text or "").translate(AZ))
        size = min(10, len(w))
        windows[size].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1) if size)
    want, changed = {}, 0
    for i, r in by_id(steps[2]).items():
        text = r.text or ""
        places = [(m.start(), m.end(), m[0]) for m in ALNUM.finditer(text.translate(AZ))]
        words = [w for _, _, w in places]
        hit = set()
        for size, known in windows.items():
            for k in range(len(words) - size + 1 if size else 0):
                if tuple(words[k : k + size]) in known:
                    hit.update(range(k, k + size))
        if 2 * len(hit) > len(words):
            continue
        out, at = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out += text[at : places[k][0]]
            at = places[k][1]
        want[i] = None if r.text is None else out + text[at:]
        changed += bool(hit)
    after = by_id(steps[3])
    assert changed and {i: r.text for i, r in after.items()} == want


def test_secrets_are_masked_and_every_document_stays(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    assert set(before) == set(after)
    for i, r in before.items():
        spans = [(kind, a, b, 1.0) for a, kind, b in base_spans(r.text or "")]
        spans += [x for x in secret_scan.scan(r.text or "") if x[0] == "named"]
        spans.sort(key=lambda x: (x[1], secret_scan.KINDS.index(x[0]), x[2]))
        assert after[i].text == (None if r.text is None else secret_scan.redact(r.text, spans, "[SECRET]"))
        assert not base_spans(after[i].text or "")


def test_the_mix_fits_its_targets_as_subset_sums(steps):
    size, docs = defaultdict(int), by_id(steps[4])
    for r in docs.values():
        size[r.source] += len(SPACED.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target.update(share)
            break
        target.update({s: 2.0 * size[s] for s in over})
        left -= sum(2.0 * size[s] for s in over)
        free -= over
    taken = defaultdict(int)
    for r in by_id(steps[5]).values():
        n = len(SPACED.findall(docs[r.doc_id].text or ""))
        assert (r.text, r.size) == (docs[r.doc_id].text, n) and 0 < r.copies <= 2 and r.taken == r.copies * n
        taken[r.source] += r.taken
    for s in order:  # whole copies of the source, every size in proportion, then the best sum of the documents left over
        sizes = [len(SPACED.findall(r.text or "")) for r in docs.values() if r.source == s]
        whole = min(2, int(target[s] // size[s])) if size[s] else 0
        budget, reach, best = round(target[s] - whole * size[s]) if whole < 2 else 0, 1, 0
        for n, count in Counter(sizes).items():
            first = int(count * (budget / size[s])) if size[s] else 0
            best += first * n
            for _ in range(count - first):
                reach |= reach << n
        best += max(k for k in range(budget - best + 1) if reach >> k & 1)
        assert taken[s] == whole * size[s] + best


def test_run_gives_the_same_rows(spark, steps):
    rows = lambda found: sorted((r.doc_id, r.text, r.size, r.copies, r.taken) for r in found)
    assert rows(corpus_pipeline.run(spark, SF).collect()) == rows(steps[5])
