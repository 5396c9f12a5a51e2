"""Spans of personal data against a plain reading of the patterns, and bootstrapped finds."""

import hashlib
import random
import re

from loanloom.llm.pii import confident_instances, redacted, report

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "no data here", "a@b.co_x@y.org and x@y z@w.d-e.f", "é😀 mail: älp.x@host-1.example.com, then 1.2.3.4.5.6.7.8", "300.1.1.1 and 0255.001.2.3 1.2.3",
    "4111 1111 1111 1111 and 4111111111111112 and 4111-1111-1111-1111 5500005555555559", "+1 (415) 555-2671 or +12 or +44 20 7946 0958. +1 2 3", "12345678901234567890 1234",
    "x" * 3000 + "@", "a@b" + ".c" * 20000, "1 " * 20000 + "2", "9" * 30000, "+1" * 500, "@@ a@@b.c a@.b", "1.2.3.4@5.6 7.8.9.10",
]


def passes(kind, hit):
    n = len(re.sub("[^0-9]", "", hit))
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        digits = [int(c) for c in hit if c.isdigit()][::-1]
        return 13 <= n <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    return kind == "email" or 9 <= n <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_base_spans(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[4]), (4, TEXTS[4])]
    got = report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for doc_id, text in rows:
        want, r = base(text), by_id[doc_id]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS], text
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text
        assert r["spans"].startswith(listed)


def test_contexts_find_unseen_identifiers(spark):
    rows = [(k, f"word{k} please write to agent user{k}@mail.example.com today and more") for k in range(12)]
    rows += [(100, "word please write to agent zz-9981-kq today and more"), (101, "in the year 20245 we agreed"), (102, "please buy item9 now")]
    got = {r["doc_id"]: r for r in report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    start = rows[12][1].index("zz-9981")
    assert got[100]["spans"] == f"context:{start}:{start + 10}" and got[100]["n_context"] == 1
    assert got[101]["spans"] == got[102]["spans"] == "" and got[3]["n_email"] == 1


def test_contexts_are_whole_words_and_instances_bare(spark):
    """Words of a context longer than any window, short words, quotes and stops at the edges of an instance."""
    long = "w" * 5000
    rows = [(k, f"{k} {long} user{k}@mail.example.com ende") for k in range(12)]
    rows += [(100, f'{long} "k7".'), (101, f"x{long} k8"), (102, f"go {'v' * 100} k9")]
    got = {r["doc_id"]: r for r in report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100]["spans"] == "context:5002:5004"
    assert got[101]["spans"] == got[102]["spans"] == ""


def plain_fixed_point(edges):
    """Scores by hand: patterns from beliefs, beliefs by noisy or, until nothing rises."""
    graph = {}
    for pattern, instance, known in edges:
        graph[pattern, instance] = max(graph.get((pattern, instance), 0.0), float(known))
    found = {}
    while True:
        beliefs = {}
        for (pattern, instance), seed in graph.items():
            beliefs.setdefault(pattern, []).append(max(seed, found.get(instance, 0.0)))
        good = {p: sum(b) / len(b) for p, b in beliefs.items() if sum(b) >= 5 and sum(b) / len(b) >= 0.8}
        miss = {}
        for (pattern, instance), seed in graph.items():
            if seed == 0 and pattern in good:
                miss[instance] = miss.get(instance, 1.0) * (1 - min(good[pattern], 0.999999))
        new = dict(found)
        for instance, m in miss.items():
            if 1 - m >= 0.9:
                new[instance] = max(1 - m, found.get(instance, 0.0))
        if all(new[i] - found.get(i, 0.0) <= 1e-6 for i in new):
            return sorted(new)
        found = new


def test_rounds_equal_a_plain_fixed_point(spark):
    """A random graph in which one pattern and one instance own a third of the edges each."""
    draw = random.Random(5)
    known = {k: draw.random() < 0.85 for k in range(150)}
    edges = [(f"p{draw.randrange(30)}", k, known[k]) for k in range(150) for _ in range(3)]
    edges += [("hot", k, known[k]) for k in range(150)] + [(f"p{k}", 149, known[149]) for k in range(30)]
    edges = [(p, str(i), k) for p, i, k in edges]
    got = confident_instances(spark.createDataFrame(edges, "pattern string, instance string, known boolean")).collect()
    want = plain_fixed_point(edges)
    assert want and sorted(r["instance"] for r in got) == want


def test_redacted_keeps_columns_and_other_text(spark):
    docs = spark.createDataFrame(
        [(1, "é mail a@b.co, card 4111 1111 1111 1111.", 5), (2, None, 6), (3, "clean", 7), (3, "clean", 7), (4, "1.2.3.4@5.6", 1)],
        "doc_id bigint, text string, k int",
    )
    out = redacted(docs)
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "é mail [EMAIL], card [CARD].", 5), (2, None, 6), (3, "clean", 7), (3, "clean", 7), (4, "[IP]", 1)], key=str)


def test_empty_table(spark):
    assert report(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
