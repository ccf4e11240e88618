"""Personal data, and terms that give it away, in DataFrame functions only.

Protected entities (mail addresses, network addresses, card and phone
numbers) are found by pattern. Corpus co-occurrence then estimates how much
each term of a document with an entity reveals about it: with N documents, the information
content of entity e is IC(e) = log2(N / df(e)) and the point-wise mutual
information of term t and e is PMI(t, e) = log2(N * df(t, e) / (df(t) * df(e))).
A term that carries at least ``general`` of IC(e) is generalised wherever it
stands in a document that holds e, one that carries at least ``remove`` of it
is removed. df(t, e) counts documents that hold both, whatever lies between
them. Terms are runs of letters and digits of any length. A pair needs
``support`` documents in which e has different surroundings, or as many
surroundings that hold t within ``reach`` code points of e, so that copies of
one text prove nothing. Words inside an entity go with it.

Edge cases: a null text counts as empty; an empty text has no spans; texts are
searched whole; ties and repeated rows get the same spans; a null doc_id is an
id like others; an empty table gives an empty result; other columns pass
through in ``sanitise``, but for the names it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored
from .spans import SPAN, matches, ordered, replaced

BASE = ("email", "ip", "card", "phone")

#: The patterns, with possessive counts where nothing is given back, and starts only where a match can start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

REACH, SUPPORT, GENERAL, REMOVE = 120, 3, 0.8, 0.95

#: A character of a term.
LETTER = r"[\p{L}\p{M}\p{N}]"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _is_ip(found: Column) -> Column:
    return F.forall(F.split(found, "\\."), lambda p: F.coalesce(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).try_cast("int") <= 255, F.lit(False)))


def _is_card(found: Column) -> Column:
    back = F.reverse(_digits(found))
    n = F.length(back)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(back, k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _is_phone(found: Column) -> Column:
    return F.length(_digits(found)).between(9, 15)


def entities(text: Column) -> Column:
    """The protected entities of a text, as ordered spans."""
    return ordered(
        matches(text, EMAIL, "email", 0),
        matches(text, IP, "ip", 1, _is_ip),
        matches(text, CARD, "card", 2, _is_card),
        matches(text, PHONE, "phone", 3, _is_phone),
    )


def found_entities(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, a hash of the text, entity spans and each span's surroundings; written to the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("__text"), entities(text).alias("spans"), text.alias("text"))

    def around(s: Column) -> Column:
        first = F.greatest(s["start"] - reach, F.lit(0))
        return F.struct(
            first.alias("from"),
            F.substring(F.col("text"), (first + 1).cast("int"), (s["start"] - first).cast("int")).alias("before"),
            F.substring(F.col("text"), (s["end"] + 1).cast("int"), F.lit(reach)).alias("after"),
        )

    return stored(base.select("doc_id", "__text", "spans", F.transform("spans", around).alias("near")))


def nearby_terms(base: DataFrame) -> DataFrame:
    """One row per word near an entity, with its place; cut words at the rim do not count."""
    one = base.where(F.size("spans") > 0).select("doc_id", "__text", F.inline(F.arrays_zip("spans", "near")))
    one = one.select("doc_id", "__text", F.concat_ws(":", "spans.kind", F.lower("spans.found")).alias("entity"), F.xxhash64("near.before", "near.after").alias("scene"), F.inline(F.array(
        F.struct(F.col("near.from").alias("from"), F.col("near.before").alias("part"), F.lit(True).alias("left")),
        F.struct(F.col("spans.end").alias("from"), F.col("near.after").alias("part"), F.lit(False).alias("left")),
    )))
    word = matches(F.col("part"), f"{LETTER}+", "term", 9)
    one = one.select("doc_id", "__text", "entity", "scene", "from", "left", F.length("part").alias("size"), F.inline(word))
    whole = F.when(F.col("left"), (F.col("start") > 0) | (F.col("from") == 0)).otherwise((F.col("end") < F.col("size")) | (F.col("size") < REACH))
    return one.where(whole).select("doc_id", "__text", "entity", "scene", F.lower("found").alias("term"), (F.col("from") + F.col("start")).alias("start"), (F.col("from") + F.col("end")).alias("end"))


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.lower(s["found"]))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, text), where doc is the id and a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct("doc_id", F.xxhash64(text).alias("__text")).alias("doc"), text.alias("text"))


def disclosing(docs: DataFrame, base: DataFrame, near: DataFrame, support: int = SUPPORT, general: float = GENERAL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity, term, share of IC(entity) that the term carries) for terms at or over ``general``; (doc, entity) and (doc, form, term) of the documents they may be in."""
    some = base.where(F.size("spans") > 0)
    each = some.select(F.struct("doc_id", "__text").alias("doc"), F.inline(F.arrays_zip("spans", "near")))
    held = each.groupBy("doc", _entity(F.col("spans")).alias("entity")).agg(F.min(F.xxhash64("near.before", "near.after")).alias("scene"))
    entity_df = some.select(F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"))
    close = stored(near.groupBy("entity", "term").agg(F.countDistinct("scene").alias("scenes")).where(F.col("scenes") >= support).select("entity", "term"))
    n = base.agg(F.count("*").alias("n"))
    ic = F.log2(F.col("n") / F.col("with_entity"))

    def share(with_term: str) -> Column:
        return F.log2(F.col("n") * F.col("both") / (F.col(with_term) * F.col("with_entity"))) / ic

    # an entity without enough surroundings has no pair with enough of them
    able = held.groupBy("entity").agg(F.countDistinct("scene").alias("scenes")).where(F.col("scenes") >= support).select("entity").union(close.select("entity")).distinct()
    able = able.join(entity_df, "entity").crossJoin(F.broadcast(n)).where(ic > 0)  # n is one row
    held = stored(held.join(able, "entity"))
    words = _texts(docs).join(held.select("doc").distinct(), "doc", "left_semi")
    words = stored(words.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"{LETTER}+"), F.lit(0)))).alias("form")).withColumn("term", F.lower("form")))
    terms = words.select("doc", "term").distinct()
    # documents that hold a term and some entity are a lower bound of df(t): pairs that fail on it fail anyway
    least = terms.groupBy("term").agg(F.count("*").alias("near_term"))
    terms = terms.join(least, "term")
    both = held.join(terms, "doc").where(F.log2(F.col("n") / F.col("near_term")) >= general * ic - 1e-9)
    pairs = both.groupBy("entity", "term", "with_entity", "near_term", "n").agg(F.countDistinct("scene").alias("scenes"), F.count("*").alias("both")).where(share("near_term") >= general)
    pairs = pairs.join(close.withColumn("close", F.lit(True)), ["entity", "term"], "left").where((F.col("scenes") >= support) | F.col("close"))
    pairs = stored(pairs)
    asked = pairs.select("term").distinct()
    seen = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(f"{LETTER}+"), F.lit(0)))).alias("term"))
    term_df = seen.join(stored(asked), "term", "left_semi").groupBy("term").agg(F.count("*").alias("with_term"))
    told = pairs.join(term_df, "term").withColumn("share", share("with_term")).where(F.col("share") >= general).select("entity", "term", "share")
    return told, held.select("doc", "entity"), words


def _places(text: Column, form: Column) -> Column:
    """Where the word ``form`` stands in a text, as an array of (start, end)."""
    pattern = F.concat(F.lit(f"(?<!{LETTER})"), form, F.lit(f"(?!{LETTER})"))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, gap: Column) -> Column:
        first = (acc["at"] + F.length(gap)).cast("bigint")
        end = (first + F.length(form)).cast("bigint")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), start, step, lambda acc: acc["out"])


def protect(docs: DataFrame, general: float = GENERAL, remove: float = REMOVE) -> DataFrame:
    """doc_id, hash of the text, ``base`` spans and ``terms`` spans (kind term or drop) of every document."""
    prepare(docs.sparkSession)
    base = found_entities(docs)
    told, held, words = disclosing(docs, base, nearby_terms(base), general=general)
    shares = held.join(stored(told), "entity").groupBy("doc", "term").agg(F.max("share").alias("share"))
    hits = words.join(shares, ["doc", "term"]).groupBy("doc").agg(F.collect_list(F.struct("form", "term", "share")).alias("hits"))
    inside = base.where(F.size("spans") > 0).select(F.struct("doc_id", "__text").alias("doc"), "spans").dropDuplicates(["doc"])
    hits = _texts(docs).join(stored(hits), "doc").dropDuplicates(["doc"]).join(inside, "doc").select("doc", "text", "spans", F.inline("hits"))
    spans = hits.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.__text").alias("__text"), "spans", "share", F.col("term").alias("found"), F.inline(_places(F.col("text"), F.col("form"))))
    spans = spans.where(~F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))))
    kind = F.when(F.col("share") >= remove, "drop").otherwise("term")
    span = F.struct("start", "end", F.when(F.col("share") >= remove, 5).otherwise(4).alias("rank"), kind.alias("kind"), "found").cast(SPAN)
    by_doc = spans.groupBy("doc_id", "__text").agg(F.collect_list(span).alias("terms"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "__doc", "__text": "__hash"})
    out = base.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__hash")), "left")
    return out.select("doc_id", "__text", F.col("spans").alias("base"), F.coalesce("terms", F.array().cast(f"array<{SPAN}>")).alias("terms"))


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with entities and telling terms replaced in ``text``; ``spans`` says where.

    An entity becomes its kind in brackets, a generalised term [TERM], a
    removed term nothing.
    """
    held = protect(docs, **how).dropDuplicates(["doc_id", "__text"]).withColumnsRenamed({"doc_id": "__doc", "__text": "__hash"})
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.join(held, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__hash")), "left")
    out = out.withColumn("spans", ordered("base", "terms"))
    by = lambda s: F.when(s["kind"] == "drop", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    return out.withColumn("text", replaced(text, F.col("spans"), by)).drop("__doc", "__hash", "base", "terms")
