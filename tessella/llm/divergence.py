"""How the sources of a language differ in their words, from sparse counts.

The distance of two groups is a sum over all kept terms of the language, most of which neither group has. So it is taken apart
by supports. If no term occurred in either group, each would add the same constant. A term that one group has adds the price of
its count against the other's zero, whatever the other has: that needs only how many terms of the group have each count. A term
that both have was then priced twice, each time against a zero that is none: a join of the groups' postings by term, summed up
by pairs of counts, sets this right.

Prices are whole numbers, and sums of whole numbers are exact.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import fields, record_batch, slices
from .scratch import forget, stored

#: Terms in fewer documents of a language are not kept; terms listed of each group; parts into which a group's terms are ranked.
LEAST_DOCS, LISTED, PARTS = 3, 200, 32
#: Distinct terms of its groups that a task holds before it sends their counts on.
HELD = 400_000
#: A probability of one, in the whole numbers that are used for it.
ONE = 1_000_000_000

# Bytes below 0x80 that are no letter become spaces; A-Z become a-z.
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def count(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: the occurrences of each term in each group of ``docs`` (text, lang, source), and the documents
    of the group that have it. Each group has a row with a null term, whose docs are all of its documents."""
    types = fields(StructType.fromDDL("lang string, source string, term string, n long, docs long"))

    def run(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        all_docs: Counter = Counter()

        def out():
            for (lang, source), (n, had) in found.items():
                own = list(n)
                yield record_batch({"lang": [lang] * len(own), "source": [source] * len(own), "term": [t.decode() for t in own], "n": [n[t] for t in own], "docs": [had[t] for t in own]}, types)
            found.clear()

        for batch in batches:
            for part in slices(batch):
                for text, *group in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                    group = tuple(group)
                    all_docs[group] += 1
                    own = terms(text)
                    n, had = found.setdefault(group, (Counter(), Counter()))
                    n.update(own)
                    had.update(set(own))
                if sum(len(n) for n, _ in found.values()) > HELD:
                    yield from out()
        yield from out()
        if all_docs:
            yield record_batch({"lang": [g for g, _ in all_docs], "source": [s for _, s in all_docs], "term": [None] * len(all_docs), "n": [0] * len(all_docs), "docs": list(all_docs.values())}, types)

    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _probability(n: str, total: str, kept: str) -> Column:
    """1 + floor(ONE * (n + 1) / (total + kept)), as a long; in decimals, which the product needs from 9 billion occurrences on."""
    return F.expr(f"1 + (CAST({ONE} AS DECIMAL(10, 0)) * (CAST({n} AS DECIMAL(20, 0)) + 1)) div ({total} + {kept})")


def _price(p: str, q: str) -> Column:
    """Both are ONE + 1 at most, so the square is a long."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _exact(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,0)"))


class Audit:
    """Counts of a table of documents, stored: ``postings`` (lang, source, term, n, lang_n) of kept terms, ``groups`` (lang,
    source, total, zero: the probability of a term that the group has not), ``langs`` (lang, kept, total)."""

    def __init__(self, docs: DataFrame):
        self._counted = counted = stored(count(docs), "term-counts")
        kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(f"docs >= {LEAST_DOCS}")
        kept = kept.select("lang", "term", "lang_n")
        self.postings = stored(counted.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "postings")
        groups = counted.where("term is null").select("lang", "source")
        totals = self.postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        found = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("total"))
        langs = groups.select("lang").distinct().join(found, "lang", "left").na.fill(0, ["kept", "total"])
        self.langs = stored(langs, "langs")
        groups = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(self.langs.select("lang", "kept"), "lang")
        zero = F.when(F.col("kept") > 0, _probability("0", "total", "nullif(kept, 0)"))
        self.groups = stored(groups.withColumn("zero", zero), "groups")

    def pairs(self) -> DataFrame:
        """lang, source, item, value: of each ordered pair of sources of a language, the sum over all kept terms."""
        p = _probability("n", "total", "kept").alias("p")
        priced = self.groups.select("lang", "source", "total", "kept", "zero")
        counts = self.postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(priced, ["lang", "source"])
        counts = stored(counts.select("lang", "source", "n", "terms", p, "zero"), "count-histograms")
        a, b = (self.groups.select("lang", F.col("source").alias(f"{x}"), F.col("zero").alias(f"{x}_zero"), *(["kept"] if x == "a" else [])) for x in "ab")
        both = a.join(b, "lang").where("a <> b")
        # every kept term as if neither group had it
        none = both.select("lang", "a", "b", (F.col("kept").cast("decimal(38,0)") * F.coalesce(_price("a_zero", "b_zero"), F.lit(0))).alias("value"))
        # what the terms of one group add to that, against the other's zero
        other = lambda x: self.groups.select("lang", F.col("source").alias(x), F.col("zero").alias(f"{x}_zero")).distinct()
        of_a = counts.select("lang", F.col("source").alias("a"), "terms", "p", F.col("zero").alias("a_zero")).join(other("b"), "lang").where("a <> b")
        of_a = of_a.groupBy("lang", "a", "b").agg(_exact(F.col("terms").cast("decimal(20,0)") * (_price("p", "b_zero") - _price("a_zero", "b_zero"))).alias("value"))
        of_b = counts.select("lang", F.col("source").alias("b"), "terms", "p", F.col("zero").alias("b_zero")).join(other("a"), "lang").where("a <> b")
        of_b = of_b.groupBy("lang", "a", "b").agg(_exact(F.col("terms").cast("decimal(20,0)") * (_price("a_zero", "p") - _price("a_zero", "b_zero"))).alias("value"))
        # terms of both
        own = self.postings.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("a_n"))
        met = own.join(own.select("lang", "term", F.col("a").alias("b"), F.col("a_n").alias("b_n")), ["lang", "term"]).where("a < b")
        met = stored(met.groupBy("lang", "a", "b", "a_n", "b_n").agg(F.count("*").alias("terms")), "overlaps")
        met = met.union(met.select("lang", "b", "a", "b_n", "a_n", "terms"))
        p_of = lambda x: counts.select("lang", F.col("source").alias(x), F.col("n").alias(f"{x}_n"), F.col("p").alias(f"{x}_p"), F.col("zero").alias(f"{x}_zero"))
        met = met.join(p_of("a"), ["lang", "a", "a_n"]).join(p_of("b"), ["lang", "b", "b_n"])
        right = _price("a_p", "b_p") - _price("a_p", "b_zero") - _price("a_zero", "b_p") + _price("a_zero", "b_zero")
        met = met.groupBy("lang", "a", "b").agg(_exact(F.col("terms").cast("decimal(20,0)") * right).alias("value"))
        every = none.union(of_a).union(of_b).union(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        return every.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.col("value").cast("long").alias("value"))

    def marked(self) -> DataFrame:
        """lang, source, item, value: of each group the terms that are more likely in it than in its language."""
        langs = self.langs.select("lang", "kept", F.col("total").alias("lang_total"))
        rows = self.postings.join(self.groups.select("lang", "source", "total"), ["lang", "source"]).join(langs, "lang")
        rows = rows.select("lang", "source", F.col("term").alias("item"), _probability("n", "total", "kept").alias("p"), _probability("lang_n", "lang_total", "kept").alias("q"))
        return rows.where("p > q").select("lang", "source", "item", _price("p", "q").alias("value"))


def _ranked(rows: DataFrame, *more: str | Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", *more).orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for ``docs`` (text, lang, source).

    Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII; a language keeps those of at least LEAST_DOCS of
    its documents. A term's probability in a group (lang, source) or a language is 1 + floor(ONE * (count + 1) / (all + kept)),
    and p against q is worth floor((p - q) ** 2 / q). Part ``pair``: each other source of the language, the sum over its kept
    terms; part ``term``: the LISTED terms of the group's own that are worth most among those that the group is likelier to have
    than the language. Ranks are by value, then by the bytes of the item.

    Null text, lang and source are empty ones; groups without kept terms have pairs (worth nothing if the language keeps none) and
    no terms; repeated rows are documents of their own; texts and terms of any length are counted whole; other columns are not
    looked at; an empty table gives an empty table.

    Texts are read once; counts are added up in tasks before they are shuffled. The join by term has a row for each term and
    pair of groups that have it. A group's terms are ranked in PARTS parts first, of which LISTED terms each go on.
    """
    found = Audit(docs)
    pairs = _ranked(found.pairs())
    terms_ = _ranked(found.marked(), F.pmod(F.xxhash64("item"), F.lit(PARTS))).where(f"rank <= {LISTED}").drop("rank")
    terms_ = _ranked(terms_).where(f"rank <= {LISTED}")
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").union(columns(terms_, "term"))
