"""One very large group: what a task or a row holds of it stays bounded, and the results are those of a plain pass."""

import hashlib
import random

from pyspark.sql import functions as F

from scholia.operators import graph as G
from scholia.operators import retrieval as S
from scholia.operators import store


def plain_heads(hits, chunks, documents, characters):
    out = []
    for q in sorted({h[0] for h in hits}):
        first = {}
        for _, source, rank in sorted((h for h in hits if h[0] == q), key=lambda h: (h[2], h[1])):
            first.setdefault(source, rank)
        used, position = 0, 0
        for source in sorted(first, key=lambda s: (first[s], s))[:documents]:
            for _, i, size in sorted((c[2], c[0], len(c[3] or "")) for c in chunks if c[1] == source):
                if used + size > characters:
                    break
                used += size
                out.append((q, position, str(i)))
                position += 1
    return sorted(out)


def test_the_head_of_a_source_is_joined_not_the_source(spark):
    rng = random.Random(1)
    sizes = {"hot": 3000, "a": 5, "b": 3, "c": 1}
    chunks, n = [], 0
    for source, k in sizes.items():
        for i in range(k):
            chunks.append((n, source, i, None if rng.random() < 0.02 else "x" * rng.randint(0, 90)))
            n += 1
    hits = [(q, rng.choice(list(sizes)), r) for q in range(12) for r in range(4)]
    c = spark.createDataFrame(chunks, "id bigint, source string, chunk_index int, text string").repartition(5)
    h = spark.createDataFrame(hits, "query_id bigint, source string, rank int")
    for documents, characters in ((1, 500), (3, 400), (3, 90)):
        got = S.whole_documents(h, c, documents, characters)
        assert sorted((r.query_id, r.position, r.id) for r in got.collect()) == plain_heads(hits, chunks, documents, characters)
        assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_records_of_sources_of_any_length(spark):
    rng = random.Random(2)
    rows = [("hot", "T", i, f"text {i} " * 20) for i in range(20_000)] + [("a", None, 0, None), ("b", "Z", 1, "two"), ("b", "A", 0, "one"), ("b", "M", 2, None), ("b", "M", 3, "ü"), ("c", "t", 0, "")]
    rng.shuffle(rows)
    df = store.ledger(spark.createDataFrame(rows, "source string, title string, chunk_index int, text string").repartition(3))
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for source in "hot a b c".split():
        mine = sorted((r for r in rows if r[0] == source), key=lambda r: r[2])
        text = "\n".join(r[3] for r in mine if r[3] is not None)
        want[source] = (min((r[1] for r in mine if r[1] is not None), default=None), len(mine), hashlib.sha256(text.encode()).hexdigest())
    assert {r.source: (r.title, r.chunk_count, r.doc_hash) for r in df.collect()} == want


def plain_exploration(seeds, relations, hops, most_entities, most_relations):
    """Hop by hop, a query at a time."""
    entities, found = {}, {}
    for q in sorted({s[0] for s in seeds}):
        order = [name for _, name, _ in sorted((s for s in seeds if s[0] == q), key=lambda s: (s[2], s[1]))]
        met = {n: (0, i) for i, n in enumerate(dict.fromkeys(order), 1) if i <= most_entities}
        took = {}
        for hop in range(1, hops + 1):
            if len(met) >= most_entities or len(took) >= most_relations:
                break
            have, new = len(met), []
            for name in sorted((n for n, (h, _) in met.items() if h == hop - 1), key=lambda n: met[n][1]):
                new += [r for r in sorted({r for r in relations if name in r[:2]})[:most_relations] if r not in took and r not in new]
            for r in new[: most_relations - len(took)]:
                took[r] = (hop, len(took) + 1)
            ends = {}
            for r, (h, place) in took.items():
                for n in r[:2]:
                    if h == hop and n not in met:
                        ends.setdefault(n, place)
            for i, n in enumerate(sorted(ends, key=lambda n: (ends[n], n))[: most_entities - have], have + 1):
                met[n] = (hop, i)
        entities |= {(q, n): x for n, x in met.items()}
        found |= {(q, *r): x for r, x in took.items()}
    return entities, found


def test_many_queries_explore_a_graph_with_a_hot_node(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(40)]
    relations = sorted({(rng.choice(names), rng.choice(names), rng.choice("xy")) for _ in range(60)} | {("hub", f"m{i}", "x") for i in range(300)} | {("n0", "hub", "y"), ("hub", "hub", "x")})
    seeds = [(q, rng.choice([*names, "hub", "nowhere"]), p) for q in range(15) for p in range(2)]
    s, r = spark.createDataFrame(seeds, "query_id bigint, name string, place int"), spark.createDataFrame([*relations, *relations[:5]], "source string, target string, type string")
    for hops, most_entities, most_relations in ((2, 50, 200), (3, 12, 9), (2, 5, 1000)):
        e, f = G.explored(s, r, hops, None, most_entities, most_relations)
        want_e, want_f = plain_exploration(seeds, relations, hops, most_entities, most_relations)
        assert {(x.query_id, x.name): (x.hop, x.place) for x in e.collect()} == want_e
        assert {(x.query_id, x.source, x.target, x.type): (x.hop, x.place) for x in f.collect()} == want_f


def test_a_context_of_hits_and_relations(spark):
    hits = spark.createDataFrame([(1, 1, "second"), (1, 0, "first"), (2, 0, "alone")], "query_id bigint, rank int, text string")
    found = spark.createDataFrame([(1, "a", "b", "T", 1, 2), (1, "c", "a", "U", 1, 1), (3, "x", "y", "T", 1, 1), (3, "x", "z", "T", 1, 41)], "query_id bigint, source string, target string, type string, hop int, place int")
    assert {r.query_id: r.context for r in G.graph_rag_context(hits, found).collect()} == {
        1: "[文档片段 1]\nfirst\n\n[文档片段 2]\nsecond\n\n[知识图谱]\nc -[U]-> a\na -[T]-> b",
        2: "[文档片段 1]\nalone",
        3: "[知识图谱]\nx -[T]-> y",
    }


def test_subgraphs_of_seeds_with_one_and_with_many_neighbours(spark, monkeypatch):
    rng = random.Random(7)
    edges = {(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}") for _ in range(40)} | {(f"leaf{i}", "hub") for i in range(50)} | {("hub", "n1"), ("n2", "n2")}
    seeds = ["leaf1", "leaf2", "hub", "n1", "n2", "n5", "alone"]
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for s in seeds:
        met, front = {s: 0}, {s}
        for hop in (1, 2, 3):
            front = {y for x in front for y in near.get(x, ())} - set(met)
            met |= dict.fromkeys(front, hop)
        want |= {(s, n, h) for n, h in met.items()}
    rel = spark.createDataFrame([(a, b, "t") for a, b in edges], "source string, target string, type string")
    names = spark.createDataFrame([(s,) for s in seeds], "name string")
    for few in (64, 1):
        monkeypatch.setattr(G, "FEW", few)
        rows = [tuple(r) for r in G.subgraph(names, rel, 3).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_every_nation_region_and_supplier_explores_the_graph(spark):
    from scholia.plans import store_queries as Q

    folder = "/root/testdata/sf0.001"
    ids = lambda t, c, add=0: {r[0] + add for r in spark.read.parquet(f"{folder}/{t}.parquet").select(c).collect()}
    want = ids("nation", "n_nationkey") | ids("region", "r_regionkey", 100) | ids("supplier", "s_suppkey", 1000)
    assert {r.query_id for r in Q.graph_exploration(spark, folder).select("query_id").distinct().collect()} == want
    assert {r.query_id for r in Q.graph_rag(spark, folder).select("query_id").collect()} >= want


def test_relations_of_a_hop_are_dealt_out_by_query(spark, monkeypatch):
    """A task takes the hubs of some of the queries, not those of all."""
    monkeypatch.setattr(G, "AT_ONCE", 1000, raising=False)
    sizes, plain = {}, G.written

    def counted(df, name):
        out = plain(df, name)
        if name == "relations":
            sizes[name] = max(r.n for r in out.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())
        return out

    monkeypatch.setattr(G, "written", counted)
    seeds = spark.createDataFrame([(q, f"hub{q % 3}", 1) for q in range(300)], "query_id bigint, name string, place int")
    relations = spark.createDataFrame([(f"m{i}", f"hub{h}", "x") for i in range(40) for h in range(3)], "source string, target string, type string")
    _, found = G.explored(seeds, relations, 1, None, 50, 20)
    assert found.count() == 300 * 20 and sizes["relations"] <= 2000
