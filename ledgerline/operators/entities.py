"""Parties: mentions that share a normalised name under a weighted rule become one entity, reversibly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise, ratio
from ..shared import Scratch
from .graph import connected

# Rule, normalisations in order, weight.
MATCH_RULES = (
    ("exact_after_case_and_whitespace", ("unicode", "whitespace", "case"), 1.0),
    ("same_after_dropping_separators", ("unicode", "whitespace", "case", "separators"), 0.9),
    ("same_ignoring_legal_form", ("unicode", "whitespace", "case", "legal_form"), 0.8),
    ("same_ignoring_legal_form_and_separators", ("unicode", "whitespace", "case", "legal_form", "separators"), 0.7),
)
MERGE = 0.65
#: Ids that are digested in one piece.
LEAF = 4096


def keys(mentions: DataFrame, rules=MATCH_RULES, threshold: float = MERGE) -> DataFrame:
    """mention_id, rule, weight, key for every rule that may merge."""
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(weight).alias("weight"), normalise(F.col("name"), list(steps)).alias("key")) for name, steps, weight in rules if weight >= threshold])
    return mentions.select("mention_id", F.explode(rows).alias("r")).select("mention_id", "r.*").where("key <> ''")


def resolve(mentions: DataFrame, rules=MATCH_RULES, threshold: float = MERGE) -> DataFrame:
    """mention_id, entity_id, canonical_name.

    Mentions of one spelling count as one name, and names are tied to the first of their key, not to each other, so a key of
    m names makes m - 1 edges. A mention whose name has no key under any rule is an entity of its own. The entity's id is the digest of its mention ids (see `digests`), its name the longest (then last) of its names.
    """
    scratch = Scratch(mentions.sparkSession, "entities")
    names = scratch.keep(mentions.where("name is not null").groupBy("name").agg(F.min("mention_id").alias("mention_id")), "names")
    own = scratch.keep(keys(names, rules, threshold).select("mention_id", "rule", "key"), "keys")
    first = own.groupBy("rule", "key").agg(F.min("mention_id").alias("b"))
    edges = own.join(first, ["rule", "key"]).select(F.col("mention_id").alias("a"), "b")
    tied = names.join(own.select("mention_id").distinct(), "mention_id").join(connected(edges), F.col("mention_id") == F.col("node"), "left").select("name", F.coalesce("component", "mention_id").alias("tied"))
    rooted = mentions.join(tied, "name", "left").withColumn("root", F.coalesce("tied", "mention_id"))
    rooted = scratch.keep(rooted.select("mention_id", "name", "root"), "rooted")
    called = rooted.groupBy("root").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("canonical_name"))
    named = digests(rooted.select("root", F.col("mention_id").cast("string").alias("id"))).join(called, "root")
    return rooted.join(named, "root").select("mention_id", F.left("digest", F.lit(20)).alias("entity_id"), "canonical_name")


def digests(members: DataFrame, leaf: int = LEAF) -> DataFrame:
    """root and digest of the distinct ids of each root, whatever their order and number.

    Up to `leaf` ids: the digest of all, sorted. Beyond that ids are dealt to leaves by their hash, twice as many whenever the number has doubled, and the digest is that of the leaves'
    digests in order. So no row holds more than about two leaves' ids, or one digest a leaf, and a root's ids are digested by as many tasks as it has leaves.
    """
    own = members.distinct()
    sizes = own.groupBy("root").agg(F.count("*").alias("m"))
    leaves = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("m") / leaf)).cast("double"))).cast("long").alias("leaves")
    dealt = own.join(sizes.select("root", leaves), "root").withColumn("leaf", F.pmod(F.xxhash64("id"), F.col("leaves")))
    each = dealt.groupBy("root", "leaves", "leaf").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\x1f"), 256).alias("digest"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "digest"))), lambda x: x["digest"]), "\x1f")
    return each.groupBy("root", "leaves").agg(F.when(F.col("leaves") == 1, F.min("digest")).otherwise(F.sha2(whole, 256)).alias("digest")).select("root", "digest")


def match_score(pairs: DataFrame, rules=MATCH_RULES) -> DataFrame:
    """Adds weight and rule to pairs of names (left_name, right_name): those of the rule of greatest weight under which both have the same key; of equal weights the rule that is declared first.

    An empty or null key matches nothing; without a match the weight is 0 and the rule null.
    """
    places = sorted(range(len(rules)), key=lambda i: (-rules[i][2], i))
    found = None
    for name, steps, weight in (rules[i] for i in places):
        left, right = normalise(F.col("left_name"), list(steps)), normalise(F.col("right_name"), list(steps))
        hit = F.when((left == right) & (left != ""), F.struct(F.lit(float(weight)).alias("weight"), F.lit(name).alias("rule")))
        found = hit if found is None else F.coalesce(found, hit)
    return pairs.withColumn("__m", found).withColumns({"weight": F.coalesce("__m.weight", F.lit(0.0)), "rule": F.col("__m.rule")}).drop("__m")


def evidence(mentions: DataFrame, entities: DataFrame, rules=MATCH_RULES, threshold: float = MERGE) -> DataFrame:
    """entity_id, rule, weight, mentions: which rules hold an entity together, attached after components are known."""
    own = keys(mentions, rules, threshold).join(entities, "mention_id")
    return own.groupBy("entity_id", "rule", "weight", "key").agg(F.count("*").alias("mentions")).where("mentions > 1").groupBy("entity_id", "rule", "weight").agg(F.sum("mentions").alias("mentions"))


def unmerge(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Split entities: `groups` (mention_id, keep_together) names who stays together; other members of a split entity stand alone."""
    known = groups.join(entities.select("mention_id", "entity_id"), "mention_id", "left")
    checked = known.withColumn("entity_id", F.when(F.col("entity_id").isNull(), F.raise_error(F.lit("unknown mention"))).otherwise(F.col("entity_id")))
    split = checked.select("entity_id").distinct().withColumn("split", F.lit(True))
    new = F.when(F.col("split").isNull(), F.col("entity_id")).otherwise(F.left(F.sha2(F.concat_ws("\x1f", "entity_id", F.coalesce(F.col("keep_together").cast("string"), F.concat(F.lit("alone "), F.col("mention_id").cast("string")))), 256), F.lit(20)))
    return entities.join(split, "entity_id", "left").join(checked.select("mention_id", "keep_together"), "mention_id", "left").select("mention_id", new.alias("entity_id"), "canonical_name")


def renamed(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities after a split with the canonical name of the members that are left: the longest, then last."""
    names = entities.select("mention_id", "entity_id").join(mentions.select("mention_id", "name"), "mention_id", "left")
    best = names.groupBy("entity_id").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("canonical_name"))
    return entities.select("mention_id", "entity_id").join(best, "entity_id").select("mention_id", "entity_id", "canonical_name")


def repoint(references: DataFrame, entities: DataFrame) -> DataFrame:
    """References (record, mention_id) with the entity that holds their mention now; one whose mention no entity holds is an error."""
    met = references.join(entities.select("mention_id", "entity_id"), "mention_id", "left")
    dangling = F.raise_error(F.concat(F.lit("dangling reference of record "), F.coalesce(F.col("record").cast("string"), F.lit("null"))))
    return met.select("record", "mention_id", F.when(F.col("entity_id").isNull(), dangling).otherwise(F.col("entity_id")).alias("entity_id"))


def _prefixes(keys: DataFrame, least: float) -> DataFrame:
    """rule, key, prefix: the rarest grams of a key, of which any key as similar as `least` has one in its own prefix.

    The ratio is 2m / s for m matched characters and lengths of sum s, and the matched characters are a common subsequence,
    so two keys share m characters and at least 3m - s - 1 bigrams, counted with repeats. For m >= least s / 2 and least over
    0.8 that is at least one for all unequal keys; below, characters take the bigrams' place. A key of n grams that must share
    o of them has one of the shared among its first n - o + 1 in any fixed order.
    """
    q = 2 if least > 0.8 else 1
    n = F.length("key")
    # The least sum of lengths that a partner within the length bound, and an unequal one at all, can make.
    total = F.greatest(n + F.ceil(n * (least / (2 - least)) - 1e-9), F.lit(1 / max(1 - least, 1e-9)))
    shared = F.greatest(F.ceil(((1.5 * least - 1) * total - 1 if q == 2 else least / 2 * total) - 1e-9), F.lit(1))
    gram = F.expr(f"transform(sequence(1, length(key) - {q - 1}), i -> substring(key, i, {q}))")
    long = keys.where(n >= q).select("rule", "key", (n - (q - 1) - shared + 1).cast("int").alias("keep"), F.explode(gram).alias("gram"))
    # A gram's repeats are told apart by number, so that sets count them.
    counted = long.groupBy("rule", "key", "keep", "gram").agg(F.count("*").cast("int").alias("times"))
    each = counted.select("rule", "key", "keep", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"), "gram")
    ranked = each.join(each.groupBy("rule", "gram", "time").agg(F.count("*").alias("df")), ["rule", "gram", "time"])
    order = F.sort_array(F.collect_list(F.struct("df", "gram", "time")))
    return ranked.groupBy("rule", "key", "keep").agg(order.alias("order")).where("keep > 0").select("rule", "key", F.slice("order", F.lit(1), F.col("keep")).alias("prefix"))


def candidates(mentions: DataFrame, least: float = 0.88, entities: DataFrame | None = None, rules=MATCH_RULES) -> DataFrame:
    """Pairs of similar but unequal names with the best ratio over all rules, for a human; never an edge.

    Names that no rule tells apart count as one, under their first mention. Each rule's keys are compared where their rare grams
    meet (see _prefixes), which loses no pair, the smaller key as the wanted one. Given the resolved entities, pairs that are one
    entity already are left out.
    """
    own = F.array(*[normalise(F.col("name"), list(steps)) for _, steps, _ in rules])
    names = mentions.where("name is not null").select("mention_id", own.alias("keys")).groupBy("keys").agg(F.min("mention_id").alias("mention_id"))
    # First key first, so that the left name is the one with the smaller first key.
    of_rule = names.select(F.struct(F.col("keys"), F.col("mention_id")).alias("who"), F.posexplode("keys").alias("rule", "key")).where("key <> ''")
    prefixes = _prefixes(of_rule.select("rule", "key").distinct(), least)
    posted = prefixes.select("rule", "key", "prefix", F.explode("prefix").alias("g"))
    a, b = posted.alias("a"), posted.alias("b")
    lengths = F.length("a.key") + F.length("b.key")
    # 2 * shorter / (sum of lengths) bounds the ratio from above.
    near = 2.0 * F.least(F.length("a.key"), F.length("b.key")) / lengths >= least
    once = F.array_intersect("a.prefix", "b.prefix")[0] == F.col("a.g")
    met = a.join(b, (F.col("a.rule") == F.col("b.rule")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.key") < F.col("b.key")) & near & once)
    # Nor are there more edits than unmatched characters.
    met = met.where(F.levenshtein("a.key", "b.key") <= (1 - least) * lengths + 1e-9)
    close = met.select(F.col("a.rule").alias("rule"), F.col("a.key").alias("ka"), F.col("b.key").alias("kb"), ratio(F.col("a.key"), F.col("b.key")).alias("similarity")).where(F.col("similarity") >= least)
    side = lambda key, who: of_rule.select("rule", F.col("key").alias(key), F.col("who").alias(who))
    named = close.join(side("ka", "x"), ["rule", "ka"]).join(side("kb", "y"), ["rule", "kb"])
    left, right = F.least("x", "y"), F.greatest("x", "y")
    out = named.groupBy(left["mention_id"].alias("left_id"), right["mention_id"].alias("right_id")).agg(F.max("similarity").alias("similarity"))
    if entities is None:
        return out
    of = lambda side: entities.select(F.col("mention_id").alias(f"{side}_id"), F.col("entity_id").alias(f"{side}_entity"))
    return out.join(of("left"), "left_id").join(of("right"), "right_id").where("left_entity <> right_entity").select("left_id", "right_id", "similarity")


def edit_candidates(mentions: DataFrame, most: int) -> DataFrame:
    """Pairs of unequal names within `most` edits.

    The shorter of two such names, cut into `most` + 1 parts, has one part that the longer one holds too, at most `most`
    characters away; names meet in these parts, so no pair is lost.
    """
    own = mentions.select("mention_id", F.lower("name").alias("key")).where("key is not null")
    keys = own.select("key").distinct()
    n, parts = F.length("key"), most + 1

    def part(length, i, shift=0):
        start, end = F.floor(length * i / parts).cast("int"), F.floor(length * (i + 1) / parts).cast("int")
        return F.struct(length.alias("length"), F.lit(i).alias("i"), F.substring(F.col("key"), start + shift + 1, end - start).alias("text")), (start + shift >= 0) & (end + shift <= n) & (length >= 0)

    held = keys.select("key", F.explode(F.array(*[part(n, i)[0] for i in range(parts)])).alias("part"))
    found = [F.when(ok, p) for i in range(parts) for d in range(most + 1) for shift in range(-most, most + 1) for p, ok in [part(n - d, i, shift)]]
    sought = keys.select("key", F.explode(F.array_distinct(F.array(*found))).alias("part")).where("part is not null")
    s, l = held.alias("s"), sought.alias("l")
    met = s.join(l, (F.col("s.part") == F.col("l.part")) & ((F.length("s.key") < F.length("l.key")) | (F.col("s.key") < F.col("l.key"))))
    close = met.select(F.col("s.key").alias("ka"), F.col("l.key").alias("kb")).distinct().withColumn("edits", F.levenshtein("ka", "kb")).where(F.col("edits") <= most)
    side = lambda key, who: own.select(F.col("key").alias(key), F.col("mention_id").alias(who))
    return close.join(side("ka", "x"), "ka").join(side("kb", "y"), "kb").where("x <> y").select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "edits")


def purity(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """entities, mixed (entities of several true parties), largest_merge (most true parties in one entity)."""
    return entities.join(truth, "mention_id").groupBy("entity_id").agg(F.countDistinct("party").alias("parties")).agg(F.count("*").alias("entities"), F.count_if(F.col("parties") > 1).alias("mixed"), F.max("parties").alias("largest_merge"))
