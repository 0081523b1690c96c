"""Personal data and the terms that give it away.

Base spans are e-mail and IP addresses, card and phone numbers, found by patterns.
Around them, information theory decides: a term discloses an entity (a kind and
value) as far as its point-wise mutual information with the entity reaches the
entity's own information content. Both come from counts of distinct texts over the
whole corpus: texts with the entity, with the term, and with the term
within ``reach`` characters of the entity. Every pair that occurs is judged, those of
one text too: a term that no other text holds gives its entity away in full. Terms that reach ``generalise`` of an
entity's information are generalised, those that reach ``remove`` of it removed, wherever they
stand, in texts without the entity too: there above all they would lead to it.

Matches are placed by running sums over blocks of BLOCK matches, so that a long text full of
them costs little more than their number.

Defined results: a null text counts as empty; rows that repeat a text count once
but each has its row in the result; a null identifier is kept as null; an entity in
every text has no information to disclose; an empty table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns of the contract in possessive form. They match the same spans: no
# repetition ends before a character that it could take, so giving back never
# helps, and a look behind stops starts inside a run whose first start has failed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}"
SPAN = "array<struct<kind:int,s:int,e:int,v:string>>"
TOKEN = "array<struct<entity:string,term:string>>"


#: Matches of a block, and spans on either side that can overlap the reach of a short span.
BLOCK, BESIDE = 64, 64


def located(text: Column, pattern: str, base: Column | int = 0) -> Column:
    """array<struct<s, e, v>> of all matches, offsets in code points from ``base`` on."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(matches, F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))
    step = lambda a, x: F.when(x["m"].isNull(), a).otherwise(
        F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["n"]).alias("e"), x["m"].alias("v")))).alias("out"))
    )
    fold = lambda xs: F.aggregate(xs, start, step)
    # Arrays of one element bind what is used more than once.
    bound = F.transform(F.array(steps), lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / BLOCK).cast("int")), lambda i: fold(F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)))))
    first = F.array((F.lit(base) if isinstance(base, int) else base).cast("int"))
    placed = F.transform(bound, lambda bs: F.zip_with(bs, F.aggregate(bs, first, lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"]))), lambda b, o: F.when(b.isNotNull(), F.transform(b["out"], lambda x: F.struct((x["s"] + o).alias("s"), (x["e"] + o).alias("e"), x["v"].alias("v")))).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))))
    return F.flatten(F.get(placed, F.lit(0)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(_digits(v)), ""), lambda c, i: c.cast("int") * (1 + i % 2) - F.when((i % 2 == 1) & (c.cast("int") > 4), 9).otherwise(0))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(v: Column) -> Column:
    def small(x: Column) -> Column:
        bare = F.regexp_replace(x, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(v, r"\."), small)



def _kind(text: Column, kind: int, pattern: str, first_look: Column, accept) -> Column:
    found = F.transform(F.filter(located(text, pattern), accept), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
    return F.when(first_look, found).otherwise(F.array()).cast(SPAN)


def base_spans(text: Column) -> Column:
    """The base spans of a text by kind, then start."""
    return F.concat(
        _kind(text, 0, EMAIL, text.contains("@"), lambda x: F.lit(True)),
        _kind(text, 1, IP, text.rlike(IP), lambda x: _octets(x["v"])),
        _kind(text, 2, CARD, text.rlike(CARD), lambda x: _luhn(x["v"])),
        _kind(text, 3, PHONE, text.contains("+") & text.rlike(PHONE), lambda x: F.length(_digits(x["v"])).between(9, 15)),
    )


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def _word_end(text: Column, at: Column, pattern: str) -> Column:
    """How far the word that ``at`` cuts goes on, by a pattern for the rest of the text on one side; 0 outside words."""
    cut = F.substring(text, at, F.lit(2)).rlike(r"^\p{L}{2}")
    rest = F.substring(text, at + 1, F.length(text)) if pattern.startswith("^") else F.substring(text, F.lit(1), at)
    return F.when(cut & (at > 0), F.length(F.regexp_extract(rest, pattern, 0))).otherwise(0)


def _near(text: Column, reach: int) -> Column:
    """Whole terms that begin or end within ``reach`` of a base span, without those that overlap one."""
    n = F.length(text)

    def around(bound: Column) -> Column:
        spans, long = bound["spans"], bound["long"]

        def beside(span: Column, i: Column) -> Column:
            entity = F.concat_ws(":", span["kind"], F.lower(span["v"]))
            lo, hi = F.greatest(span["s"] - reach, F.lit(0)), F.least(span["e"] + reach, n)
            edge = F.struct((lo - _word_end(text, lo, r"\p{L}+$")).alias("lo"), (hi + _word_end(text, hi, r"^\p{L}+")).alias("hi"))
            # Short spans: only so many others can overlap their reach, but for long ones.
            few = (F.size(spans) <= 2 * BESIDE) | (span["e"] - span["s"] > reach)
            others = F.when(few, spans).otherwise(F.concat(F.slice(spans, F.greatest(i - BESIDE, F.lit(0)) + 1, F.lit(2 * BESIDE + 1)), long))
            clear = lambda x, all_: ~F.exists(all_, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
            found = F.flatten(F.transform(F.array(edge), lambda w: F.concat(located(F.substring(text, w["lo"] + 1, span["s"] - w["lo"]), TERM, w["lo"]), located(F.substring(text, span["e"] + 1, w["hi"] - span["e"]), TERM, span["e"]))))
            kept = F.flatten(F.transform(F.array(others), lambda all_: F.filter(found, lambda x: clear(x, all_))))
            return F.transform(kept, lambda x: F.struct(entity.alias("entity"), F.lower(x["v"]).alias("term")))

        return F.array_distinct(F.flatten(F.transform(spans, beside)))

    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["v"].alias("v"))))
    bound = F.transform(F.array(ordered), lambda spans: F.struct(spans.alias("spans"), F.filter(spans, lambda x: x["e"] - x["s"] > reach).alias("long")))
    return F.flatten(F.transform(bound, around))


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    reach: int = 60,
    generalise: float = 0.85,
    remove: float = 0.95,
    with_text: bool = False,
) -> DataFrame:
    """One row per input row: identifier, spans, terms and, on request, text and sanitised text.

    ``spans`` are base spans; ``terms`` are structs (kind 4, s, e, v) whose v
    is "generalise" or "remove".
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spanned = base.withColumn("row", F.monotonically_increasing_id()).withColumn("spans", base_spans(F.col("text")))
    near = F.when(F.size("spans") > 0, _near(F.col("text"), reach)).otherwise(F.array()).cast(TOKEN)
    digest = F.sha2(F.col("text"), 256).alias("digest")
    found = scratch.keep(spanned.select("row", "id", "spans", near.alias("near"), digest, *(["text"] if with_text else [])), "found")

    # Copies of a text say no more than the text does.
    once = found.select("digest", "spans", "near").dropDuplicates(["digest"])
    n_docs = found.select("digest").distinct().count()
    pairs = once.select(F.explode("near").alias("p")).groupBy("p.entity", "p.term").agg(F.count("*").alias("both"))
    pairs = scratch.keep(pairs, "pairs")
    entities = once.select(F.explode(F.array_distinct(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], F.lower(x["v"]))))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = pairs.select("term").distinct()
    texts = base.select("text", digest).dropDuplicates(["digest"])
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    # An inner join: the optimiser would move a semi-join below the count, onto every word.
    counted = words.groupBy("term").agg(F.count("*").alias("n_term")).join(terms, "term")
    content = F.log2(F.lit(float(max(n_docs, 1))) / F.col("n_entity"))
    pmi = F.log2(F.lit(float(max(n_docs, 1))) * F.col("both") / (F.col("n_entity") * F.greatest("n_term", "both").cast("double")))
    judged = pairs.join(entities, "entity").join(counted, "term").where(content > 0).withColumn("disclosed", pmi / content).where(F.col("disclosed") >= generalise)
    acts = scratch.keep(judged.groupBy("term").agg(F.max(F.when(F.col("disclosed") >= remove, "remove").otherwise("generalise")).alias("act")), "acts")
    # Wherever such a term stands: which texts hold one, and where it is in them.
    held = base.select("text", digest).select("digest", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")).join(acts, "term")
    told = scratch.keep(held.groupBy("digest").agg(F.collect_set(F.struct("term", "act")).alias("told")), "told")
    # Kept, as the optimiser would move the search for spans into the look at each term.
    some = scratch.keep(texts.join(told, "digest").withColumn("spans", base_spans(F.col("text"))), "some")
    act = lambda x: F.get(F.filter("told", lambda t: t["term"] == F.lower(x["v"])), F.lit(0))["act"]
    free = F.filter(located(F.col("text"), TERM), lambda x: ~F.exists("spans", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    marked = F.filter(F.transform(free, lambda x: F.struct(F.lit(4).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), act(x).alias("v"))), lambda x: x["v"].isNotNull())
    per_text = some.select("digest", marked.cast(SPAN).alias("terms"))
    out = found.drop("near").join(per_text, "digest", "left").drop("digest").withColumn("terms", F.coalesce("terms", F.array().cast(SPAN)))
    if with_text:
        out = out.withColumn("sanitised", sanitised("text", "spans", "terms"))
    return out.drop("row").withColumnRenamed("id", id_col)


def sanitised(text: str, spans: str, terms: str) -> Column:
    """The text with base spans named by kind, terms generalised to [TERM] or removed."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.sort_array(F.transform(F.concat(spans, terms), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["v"] == "remove", "").otherwise(F.get(marks, x["kind"])).alias("m"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    # Where spans of two kinds overlap, the first stands for what they share.
    step = lambda a, x: F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(F.substring(F.col(text), a["at"] + 1, x["s"] - a["at"]), x["m"])).alias("out"))
    )
    return F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), a["at"] + 1, F.length(text))))
