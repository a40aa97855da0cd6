"""The crawl's own order and page budget over a stored link table.

A crawl takes pages from a queue; a link is appended, repeated or not, unless its page was
visited or ``pages + queue`` has reached the budget.  That sum is a counter with a ceiling:
a fetched page leaves it as it is, a queue entry that is skipped takes 1 off, a link adds 1
below the ceiling.  After steps whose plain sum is X its value is

    c + X - max(0, largest (c + X) so far - ceiling),

so a running sum and a running maximum over the steps, in queue order, say exactly which
links are appended.  Both run over ranged partitions: each partition sums up by itself, one
row per partition is added up over the partitions, and the rows take their partition's
offset.  The queue of a level is one such table; no step depends on driver state.

More seeds than the budget start the sum above the ceiling; the first so many skipped
entries only bring it back to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.iterate import cut
from linkloom.operators.joins import join_side_table


def ranged(df: DataFrame, order: list) -> DataFrame:
    """Stored rows with ``part``: partitions are ranges of (site, order), so a large site has many."""
    return cut(df.repartitionByRange("site", *order).withColumn("part", F.spark_partition_id()))


def running(df: DataFrame, order: list, sums: dict[str, Column], peaks: tuple = ()) -> DataFrame:
    """``df`` (ranged) with each name's sum over the site's rows up to this one, and for ``peaks`` also
    the largest such sum before this row (``<name>_peak``, null at first)."""
    here = Window.partitionBy("site", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("site", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *[F.sum(c).over(here).alias(f"_{n}") for n, c in sums.items()])
    totals = out.groupBy("site", "part").agg(*[F.max_by(f"_{n}", F.struct(*order)).alias(f"_t_{n}") for n in sums],
                                             *[F.max(f"_{n}").alias(f"_p_{n}") for n in peaks])
    before = Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = totals.select("*", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    totals = totals.select("site", "part", *[f"_o_{n}" for n in sums],
                           *[F.max(F.col(f"_o_{n}") + F.col(f"_p_{n}")).over(before).alias(f"_b_{n}") for n in peaks])
    out = out.select("*", *[F.max(f"_{n}").over(earlier).alias(f"_m_{n}") for n in peaks])
    out = join_side_table(out, totals, ["site", "part"], spread_key=order[0])
    made = [(F.col(f"_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    made += [F.greatest(F.col(f"_b_{n}"), F.col(f"_m_{n}") + F.col(f"_o_{n}")).alias(f"{n}_peak") for n in peaks]
    return out.select(*df.columns, *made)


def crawl(links: DataFrame, seeds: DataFrame, stored: DataFrame | None = None, max_depth: int = 3, max_pages: int = 500,
          focus_prefix: str | None = None) -> DataFrame:
    """(site, url, depth, no) of the pages a crawl visits, ``no`` their order within the site.

    ``links(site, src, href, pos)``: a page's links in order of ``pos``, repeated ones included;
    ``seeds(site, url, pos)``: the queue at first (a url's first place counts); ``stored(site, url)``: pages that can
    be fetched, others are visited without a page; ``focus_prefix``: from depth 1 on only links that start with it are followed.
    """
    ceiling = F.lit(max_pages).cast("long")
    arcs = links.select("site", F.col("src").alias("url"), "href", "pos")
    if stored is not None:
        stored = cut(stored.select("site", "url").distinct())
        arcs = arcs.join(stored, ["site", "url"], "left_semi")
    arcs = cut(arcs)
    queue = seeds.groupBy("site", "url").agg(F.min("pos").alias("at"))
    at_start = queue.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    # per site: pages so far, the sum at most at the ceiling, and by how much it is above it
    state = cut(at_start.select("site", F.lit(0).cast("long").alias("pages"), F.least("n", ceiling).alias("sum"),
                                F.greatest(F.lit(0), F.col("n") - ceiling).alias("above")))
    visited, pages = None, []
    for depth in range(max_depth + 1):
        # a url's first entry decides; one row per url meets the visited and the stored pages, not every repeat
        first = queue.groupBy("site", "url").agg(F.min("at").alias("at")).withColumn("fresh", F.lit(True))
        if visited is not None:
            first = first.join(visited.select("site", "url"), ["site", "url"], "left_anti")
        if stored is not None:
            first = first.join(stored.withColumn("page", F.lit(True)), ["site", "url"], "left")
        else:
            first = first.withColumn("page", F.lit(True))
        no = F.lit(False)
        entries = queue.join(first, ["site", "url", "at"], "left").select(
            "site", "url", "at", F.coalesce("fresh", no).alias("fresh"), F.coalesce("page", no).alias("page"))
        entries = running(ranged(entries, ["at"]), ["at"], {"fetched": F.col("page").cast("long"), "skipped": (~F.col("page")).cast("long")})
        entries = join_side_table(entries, state, ["site"], spread_key="at")
        no = F.col("pages") + F.col("fetched")
        # an entry is taken while there are fewer pages than the budget before it
        taken = cut(entries.filter(no - F.col("page").cast("long") < ceiling).select("site", "url", "at", "fresh", "page", no.alias("no"), "skipped", "above"))
        pages.append(taken.filter("page").select("site", "url", F.lit(depth).alias("depth"), "no"))
        if depth == max_depth:
            break
        now = taken.filter("fresh").select("site", "url", F.col("at").alias("seen"))
        known = now if visited is None else now.unionByName(visited)
        found = taken.filter("page").select("site", "at", "url").join(arcs, ["site", "url"]).select("site", "at", "pos", F.col("href").alias("url"))
        if focus_prefix is not None and depth >= 1:
            found = found.filter(F.col("url").cast("string").startswith(focus_prefix))
        found = found.join(known, ["site", "url"], "left").filter(F.col("seen").isNull() | (F.col("seen") > F.col("at")))
        found = found.select("site", "at", "pos", "url", F.lit(1).cast("long").alias("step"))
        # skipped entries stand before the links of later ones; the first ``above`` of them change nothing
        skips = taken.filter(~F.col("page")).select("site", "at", F.lit(None).cast(arcs.schema["pos"].dataType).alias("pos"),
                                                    F.lit(None).cast(arcs.schema["href"].dataType).alias("url"),
                                                    F.when(F.col("skipped") <= F.col("above"), 0).otherwise(-1).cast("long").alias("step"))
        order = ["at", "pos"]  # null, the entry itself, comes first
        steps = running(ranged(found.unionByName(skips), order), order, {"x": F.col("step")}, peaks=("x",))
        steps = cut(join_side_table(steps, state.select("site", "sum"), ["site"], spread_key="at"))

        def above(peak: Column) -> Column:
            return F.greatest(F.lit(0), F.col("sum") + F.greatest(F.coalesce(peak, F.lit(0)), F.lit(0)) - ceiling)

        before = F.col("sum") + F.col("x") - F.col("step") - above(F.col("x_peak"))
        appended = running(ranged(steps.filter((F.col("step") == 1) & (before < ceiling)).select("site", "url", "at", "pos"), order), order,
                           {"place": F.lit(1).cast("long")})
        queue = cut(appended.select("site", "url", F.col("place").alias("at")))
        ends = steps.groupBy("site").agg(F.max_by("x", F.struct("at", F.col("pos").isNotNull(), "pos")).alias("x"), F.max("x").alias("peak"))
        fetched = taken.groupBy("site").agg(F.count(F.when(F.col("page"), 1)).alias("more"), F.count(F.when(~F.col("page"), 1)).alias("skips"))
        state = cut(state.join(ends, "site", "left").join(fetched, "site", "left").select(
            "site", (F.col("pages") + F.coalesce("more", F.lit(0))).alias("pages"),
            (F.col("sum") + F.coalesce("x", F.lit(0)) - above(F.col("peak"))).alias("sum"),
            F.greatest(F.lit(0), F.col("above") - F.coalesce("skips", F.lit(0))).alias("above")))
        visited = cut(known.select("site", "url", F.lit(-1).cast("long").alias("seen")))  # before every later entry
        if queue.isEmpty():
            break
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out
