"""The crawl over a link table against a literal queue."""

import random
from collections import deque

from linkloom.operators.crawl_queue import crawl


def literal(links, seeds, stored, max_depth, max_pages, focus=None):
    queue, visited, pages = deque(), set(), {}
    for s in seeds:
        if all(s != q for q, _ in queue):
            queue.append((s, 0))
    while queue and len(pages) < max_pages:
        url, depth = queue.popleft()
        if url in visited or depth > max_depth:
            continue
        visited.add(url)
        if url not in stored:
            continue
        pages[url] = depth
        for href in links.get(url, []):
            if href not in visited and len(pages) + len(queue) < max_pages:
                if focus and not href.startswith(focus) and depth >= 1:
                    continue
                queue.append((href, depth + 1))
    return [(u, d, i + 1) for i, (u, d) in enumerate(pages.items())]


def graph(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 14)
    urls = [rng.choice("ab") + str(i) for i in range(n)]
    links = {u: [rng.choice(urls) for _ in range(rng.randint(0, 6))] for u in urls}
    stored = {u for u in urls if rng.random() < 0.75}
    return links, [rng.choice(urls) for _ in range(rng.randint(1, 9))], stored


def tables(spark, graphs):
    arcs = [(f"s{g}", u, h, i) for g, (links, _, _) in enumerate(graphs) for u, hs in links.items() for i, h in enumerate(hs)]
    seeds = [(f"s{g}", u, i) for g, (_, first, _) in enumerate(graphs) for i, u in enumerate(first)]
    stored = [(f"s{g}", u) for g, (_, _, has) in enumerate(graphs) for u in has]
    return (spark.createDataFrame(arcs, "site string, src string, href string, pos long").repartition(5),
            spark.createDataFrame(seeds, "site string, url string, pos long"), spark.createDataFrame(stored, "site string, url string"))


def compare(spark, graphs, max_depth, max_pages, focus=None):
    got = {}
    for r in crawl(*tables(spark, graphs), max_depth, max_pages, focus).collect():
        got.setdefault(r.site, []).append((r.url, r.depth, r.no))
    for g, (links, seeds, stored) in enumerate(graphs):
        want = literal(links, seeds, stored, max_depth, max_pages, focus)
        assert sorted(got.get(f"s{g}", []), key=lambda x: x[2]) == want, (g, links, seeds, stored)


def test_random_graphs(spark):
    """Repeated queue entries, pages that can't be fetched, more seeds than pages: each graph is a site."""
    compare(spark, [graph(i) for i in range(200)], 3, 6)


def test_focus_and_large_budget(spark):
    graphs = [graph(1000 + i) for i in range(100)]
    compare(spark, graphs, 2, 9, "a")
    compare(spark, graphs, 1, 500)


def test_site_over_many_partitions(spark):
    """One site's queue lies in several ranges."""
    rng = random.Random(4)
    urls = [f"u{i}" for i in range(400)]
    links = {u: [rng.choice(urls) for _ in range(8)] for u in urls}
    one = [(links, urls[:40], set(urls[::2]) | set(urls[:50]))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(spark, one, 2, 120)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty(spark):
    none = spark.createDataFrame([], "site string, src string, href string, pos long")
    assert crawl(none, spark.createDataFrame([], "site string, url string, pos long")).count() == 0
