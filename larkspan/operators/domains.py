"""Hosts against tables of domains: lists by suffix, public suffixes, and domains that look alike.

All three work on distinct hosts, so that a host of many rows is looked at once, and meet their
tables by equality of keys: label suffixes for lists and public suffixes; for lookalikes the
strings that one deletion leaves, and the rarest q-grams. No plan holds a table as literals, and no
row of one side meets all of the other.

Defined results: null hosts stay out (with_listed() keeps their rows, unmatched); hosts and domains
are compared in lower case, trimmed and without a dot at the end; an empty table matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import urls as U
from larkspan.functions.text import let
from larkspan.operators import joins, wording
from larkspan.operators.joins import is_small, measured_join

_IPV4 = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"
#: An official domain as like as this is taken for, and the longest label that one letter off counts for.
ALIKE = 0.85
SHORT_LABEL = 8
Q = 3
NEAR, SIMILAR, INSIDE = 0.90, 0.85, 0.80


def plain(host: Column) -> Column:
    """A host as it is compared."""
    return F.rtrim(F.lower(F.trim(host)), F.lit("."))


def last_labels(labels: Column, k: Column | int) -> Column:
    """The last ``k`` labels of an array, joined; all if there are no more."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")


def label_suffixes(host: Column, least: int = 1, most: int | None = None) -> Column:
    """array<struct(suffix, labels)>: the host and what is left of it after each dot, of ``least`` to ``most`` labels."""

    def of(labels: Column) -> Column:
        top = F.size(labels) if most is None else F.least(F.size(labels), F.lit(most))
        each = F.transform(F.sequence(F.lit(least), top), lambda k: F.struct(last_labels(labels, k).alias("suffix"), k.alias("labels")))
        return F.when(top >= least, each).otherwise(F.array().cast("array<struct<suffix:string,labels:int>>"))

    return let(F.split(host, "\\."), of)


def _distinct_hosts(rows: DataFrame, host_col: str) -> DataFrame:
    return rows.select(F.col(host_col).alias("host")).filter("host IS NOT NULL").distinct().withColumn("own", plain(F.col("host"))).filter("own <> ''")


def listed(hosts: DataFrame, entries: DataFrame, host_col: str = "host", domain_col: str = "domain", by: tuple[str, ...] = (), itself: bool = True) -> DataFrame:
    """host, domain and the columns of its entry, for every distinct host that is one of the domains (if ``itself``) or below one.

    The longest domain wins, one for each value of the columns ``by``; of entries with the same domain and ``by``, that
    with the greatest other columns. The columns of ``entries`` must not be called host, own, suffix or labels.
    """
    more = [c for c in entries.columns if c != domain_col and c not in by]
    table = entries.withColumn("suffix", plain(F.col(domain_col))).filter("suffix IS NOT NULL AND suffix <> ''").drop(domain_col).distinct()
    labels = F.size(F.split("suffix", "\\."))
    facts = table.agg(F.count(F.lit(1)).alias("n"), F.min(labels).alias("least"), F.max(labels).alias("most")).first()
    least, most = (facts["least"], facts["most"]) if facts["n"] else (1, 0)
    own = _distinct_hosts(hosts, host_col)
    # only suffixes as long as some entry are looked up: the last label of all hosts is no key unless a list has it
    each = own.select("host", "own", F.inline(label_suffixes(F.col("own"), least, most)))
    if not itself:
        each = each.filter("suffix <> own")
    met = measured_join(each.drop("own"), table, ["suffix"], F.col("host"), small=facts["n"] <= joins.BROADCAST_ROWS)
    best = met.groupBy("host", *by).agg(F.max(F.struct("labels", "suffix", *more)).alias("best"))
    return best.select(F.col("host").alias(host_col), F.col("best.suffix").alias(domain_col), *by, *[F.col(f"best.{c}").alias(c) for c in more])


def with_listed(rows: DataFrame, entries: DataFrame, host_col: str = "host", domain_col: str = "domain", itself: bool = True) -> DataFrame:
    """``rows`` with the entry of its host, null where there is none.

    Hosts that are listed come back to the rows under ``SALTS`` keys each, so that the rows of a common host are dealt to as many tasks.
    """
    plain_columns = [c for c in rows.columns if rows.schema[c].dataType.typeName() not in ("map", "variant")]
    return measured_join(rows, listed(rows, entries, host_col, domain_col, itself=itself), [host_col], F.xxhash64(*plain_columns), "left", small=False)


def public_suffixes(hosts: DataFrame, suffix_rules: DataFrame, host_col: str = "host", rule_col: str = "rule", default: bool = False) -> DataFrame:
    """host, suffix, registered of every distinct host by a table of public suffix rules.

    A rule is a suffix (``co.uk``), a wildcard (``*.ck``: any one label and that suffix) or an exception (``!www.ck``). An
    exception wins and stands for the suffix without its first label; else the longest rule wins. The registered
    domain is the suffix and the label before it, or the host where there is no such label. A host without a rule has
    no suffix (empty) and is registered itself; with ``default``, its last label is a suffix. IPv4 addresses are
    themselves. Labels in Unicode and in Punycode are the same. Empty rules and those that begin with // are notes.
    """
    text = F.lower(F.trim(F.col(rule_col)))
    noted = suffix_rules.select(text.alias("r")).filter("r IS NOT NULL AND r <> '' AND NOT startswith(r, '//')")
    kind = F.when(F.col("r").startswith("!"), 2).when(F.col("r").startswith("*."), 1).otherwise(0)
    table = noted.select(U.decoded_host(F.regexp_replace("r", r"^(?:!|\*\.)", "")).alias("suffix"), kind.alias("kind")).distinct()
    own = _distinct_hosts(hosts, host_col).withColumn("labels_of", F.split("own", "\\."))
    n = F.size("labels_of")
    named = own.filter(~F.col("own").rlike(_IPV4))
    each = named.select("host", n.alias("n"), F.inline(label_suffixes(U.decoded_host(F.col("own")))))
    met = measured_join(each, table, ["suffix"], F.col("host"))
    long = F.when(F.col("kind") == 2, F.col("labels") - 1).when((F.col("kind") == 1) & (F.col("n") > F.col("labels")), F.col("labels") + 1).when(F.col("kind") == 0, F.col("labels"))
    best = met.withColumn("long", long).filter("long IS NOT NULL").groupBy("host").agg(F.max(F.struct((F.col("kind") == 2).alias("exception"), "long"))["long"].alias("long"))
    found = own.join(best, "host", "left")
    k = F.coalesce("long", F.when(F.col("own").rlike(_IPV4), 0).otherwise(1 if default else 0))
    suffix = F.when(k > 0, last_labels(F.col("labels_of"), k)).otherwise("")
    registered = F.when((k > 0) & (n > k), last_labels(F.col("labels_of"), k + 1)).otherwise(F.col("own"))
    return found.select(F.col("host").alias(host_col), suffix.alias("suffix"), registered.alias("registered"))


def deletions(label: Column) -> Column:
    """The label and all that one deletion leaves of it; labels at most one edit apart share one of these."""
    left = F.transform(F.sequence(F.lit(1), F.length(label)), lambda k: F.concat(F.substring(label, F.lit(1), k - 1), F.substring(label, k + 1, F.length(label))))
    return F.array_distinct(F.concat(F.array(label), F.when(F.length(label) > 0, left).otherwise(F.array().cast("array<string>"))))


def grams(value: Column) -> Column:
    """array<struct(gram, nth)>: the q-grams of a string, repeats told apart by number."""
    raw = F.when(F.length(value) >= Q, F.transform(F.sequence(F.lit(1), F.length(value) - (Q - 1)), lambda k: F.substring(value, k, F.lit(Q)))).otherwise(F.array().cast("array<string>"))
    return let(raw, lambda gs: F.transform(gs, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(gs, 1, i + 1), lambda h: h == g)).alias("nth"))))


def _prefixes(values: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
    """(value, gram, nth): of every value as many of its rarest grams as its longest possible partner can lose, and one more.

    k edits touch at most k * Q grams, so two strings within k edits have one of their k * Q + 1 rarest grams in common,
    whatever the order, as long as it is the same for both.
    """
    each = values.select("value", F.inline(grams(F.col("value"))))
    ranked = measured_join(each, counts, ["gram", "nth"], F.col("value"), "left", small)
    place = F.row_number().over(Window.partitionBy("value").orderBy(F.coalesce("n", F.lit(0)), "gram", "nth"))
    # of partners at least this alike the longer has at most length / ALIKE characters
    edits = F.floor((1 - ALIKE) * F.length("value") / ALIKE + 1e-9)
    return ranked.withColumn("place", place).filter(F.col("place") <= edits * Q + 1).select("value", "gram", "nth")


def alike(values: DataFrame, others: DataFrame, least: float = ALIKE) -> DataFrame:
    """(value, other): distinct strings of ``values`` and ``others`` whose similarity, 1 - edits / longer length, is ``least`` or more.

    Candidates share a rare q-gram and have lengths within reach; each is verified. Strings of fewer than Q characters
    are alike only if equal.
    """
    if least < ALIKE:
        raise ValueError(f"the index holds for a similarity of {ALIKE} or more")
    a, b = (d.select(F.col(d.columns[0]).alias("value")).filter("value IS NOT NULL").distinct() for d in (values, others))
    every = b.select(F.inline(grams(F.col("value"))))
    small = is_small(every)
    counts = every.groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("n"))
    mine, theirs = _prefixes(a, counts, small), _prefixes(b, counts, small).withColumnRenamed("value", "other")
    far = F.abs(F.length("value") - F.length("other"))
    longer = F.greatest(F.length("value"), F.length("other"))
    pairs = measured_join(mine, theirs, ["gram", "nth"], F.col("value"), small=small).filter(far <= (1 - least) * longer + 1e-9).select("value", "other").distinct()
    short = a.filter(F.length("value") < Q).join(b.select(F.col("value").alias("other")), F.col("value") == F.col("other"))
    return pairs.filter(U.similarity(F.col("value"), F.col("other")) >= least).unionByName(short)


def one_letter_off(values: DataFrame, others: DataFrame) -> DataFrame:
    """(value, other): distinct strings exactly one edit apart."""
    a, b = (d.select(F.col(d.columns[0]).alias("value")).filter("value IS NOT NULL").distinct() for d in (values, others))
    mine = a.select("value", F.explode(deletions(F.col("value"))).alias("key"))
    theirs = b.select(F.col("value").alias("other"), F.explode(deletions(F.col("value"))).alias("key"))
    met = measured_join(mine, theirs, ["key"], F.col("value"))
    return met.filter(F.levenshtein("value", "other") == 1).select("value", "other").distinct()


def lookalikes(hosts: DataFrame, officials: DataFrame, suffix_rules: DataFrame, host_col: str = "host", domain_col: str = "domain", order_col: str = "ord") -> DataFrame:
    """host, domain, confidence: for every foreign host that resembles an official domain, the first such domain by ``order_col``.

    A host resembles a domain if its core label (at most ``SHORT_LABEL`` letters) is one edit from the domain's (0.90), if
    its registered domain is as like the domain as ``ALIKE`` (0.85), or if it holds the domain's core label (0.80); the first
    of these that holds gives the confidence. Hosts that are official or below an official domain are not foreign.
    """
    known = officials.select(plain(F.col(domain_col)).alias("domain"), F.col(order_col).cast("long").alias("ord")).filter("domain <> ''").groupBy("domain").agg(F.min("ord").alias("ord"))
    own = _distinct_hosts(hosts, host_col)
    foreign = own.join(listed(own, known.select("domain"), "host").select("host"), "host", "left_anti")
    core = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    registered = public_suffixes(foreign, suffix_rules, "host").select("host", "registered", core("registered").alias("label"))
    cores = public_suffixes(known.withColumnRenamed("domain", "host"), suffix_rules, "host").select(F.col("host").alias("domain"), core("registered").alias("core"))
    table = known.join(cores, "domain").select("domain", "core", F.struct("ord", "domain").alias("at"))

    def first(pairs: DataFrame, key: str, other: str, sure: float) -> DataFrame:
        """(key, a struct of what comes first by order) of pairs of the key and a domain or core label."""
        met = pairs.join(table.select(F.col(other).alias("other"), "at"), "other")
        return met.groupBy(key).agg(F.min("at").alias("at")).select(key, F.struct("at.ord", "at.domain", F.lit(-sure).alias("sure")).alias(f"by_{other}_{key}"))

    near = one_letter_off(registered.filter(F.length("label") <= SHORT_LABEL).select("label"), table.select("core")).withColumnRenamed("value", "label")
    similar = alike(registered.select("registered"), table.select("domain")).withColumnRenamed("value", "registered")
    words = table.select("core").distinct().select(F.col("core").alias("rule"), F.col("core").alias("word"))
    inside = wording.occurrences(foreign.select("host", "own"), words, "host", "own", skip=False).select("host", F.col("rule").alias("other")).distinct()
    parts = [first(near, "label", "core", NEAR), first(similar, "registered", "domain", SIMILAR), first(inside, "host", "core", INSIDE)]
    found = registered
    for part in parts:
        found = found.join(part, part.columns[0], "left")
    best = found.select("host", F.least(*[F.col(p.columns[1]) for p in parts]).alias("best")).filter("best IS NOT NULL")
    return best.select(F.col("host").alias(host_col), F.col("best.domain").alias(domain_col), (-F.col("best.sure")).alias("confidence"))
