"""Text analytics by document: sentences, n-grams, intentionality, coherence and entities.

Tables have (doc_id, text). Whatever the running state of a reader would be is a window or a fold over
one document, so documents are independent of each other and of their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COHERENCE, RHO, SKIM = 45, 1 / 30, 15
CAPS = {2: 0, 3: 150, 4: 150, 5: 45}
ENDINGS = set("a all an and are as at be because but for from has he i in is it's its my no of or she that the their then they to using was what which who with yay yeah yes your".split())
STARTERS = set("also and are because but him in is it me no of or that the them these those was were yay yeah yes".split())


def clean(text: Column) -> Column:
    """Tags become a colon and a new line; square brackets go."""
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ":\n"), r"[\[\]]", "")


def sentences(docs: DataFrame, cleaned: bool = True) -> DataFrame:
    """(doc_id, ord, sentence): parts after a full stop, exclamation or question mark, or of lines; from 1."""
    text = clean(F.col("text")) if cleaned else F.col("text")
    parts = F.filter(F.transform(F.split(text, r"(?<=[!?.])\s+|\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("i", "sentence")).select("doc_id", (F.col("i") + 1).alias("ord"), "sentence")


def words(s: DataFrame) -> DataFrame:
    """(doc_id, ord, pos, word) of sentences, in lower case."""
    parts = F.filter(F.split(F.lower("sentence"), r"\s+"), lambda x: x != "")
    return s.select("doc_id", "ord", F.posexplode(parts).alias("pos", "word"))


def vocabulary(s: DataFrame) -> DataFrame:
    return words(s).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def static_score(text: Column, freq: Column) -> Column:
    """Length times frequency, damped beyond the coherence length; 0 below two occurrences."""
    f = freq.cast("double")
    return F.when(f < 2, 0.0).otherwise(f * F.length(text) / (1 + F.exp(f / COHERENCE - RHO)))


def static_ranks(s: DataFrame) -> DataFrame:
    """(doc_id, ord, score): the static scores of a sentence's words by their frequency in the document."""
    n = F.count("*").over(Window.partitionBy("doc_id", "word"))
    return words(s).withColumn("n", n).groupBy("doc_id", "ord").agg(F.sum(static_score(F.col("word"), F.col("n"))).alias("score"))


def running_ranks(s: DataFrame) -> DataFrame:
    """(doc_id, ord, score): a word counts its length when new, less the sooner it comes again."""
    last = F.lag("ord").over(Window.partitionBy("doc_id", "word").orderBy("ord", "pos"))
    w = words(s).withColumn("last", last)
    own = F.when(F.col("last").isNull(), F.length("word")).otherwise(F.length("word") * (1 - F.exp(-(F.col("ord") - F.col("last")) / F.lit(float(COHERENCE)))))
    return w.withColumn("s", own).groupBy("doc_id", "ord").agg(F.sum("s").alias("score"))


def select_top(ranks: DataFrame, percent: float) -> DataFrame:
    """The top share of each document's sentences, one at least; of equal scores the earlier first."""
    by = Window.partitionBy("doc_id")
    nth = F.row_number().over(by.orderBy(F.round("score", 6).desc(), "ord"))
    most = F.greatest(F.lit(1), F.bround(F.count("*").over(by) * percent / 100).cast("int"))
    return ranks.withColumn("nth", nth).withColumn("most", most).where("nth <= most").drop("nth", "most")


def significant(docs: DataFrame, percent: float = 50.0) -> DataFrame:
    """(doc_id, ord, sentence) that are in the top share by either score."""
    s = sentences(docs)
    chosen = select_top(running_ranks(s), percent).select("doc_id", "ord").union(select_top(static_ranks(s), percent).select("doc_id", "ord")).distinct()
    return s.join(chosen, ["doc_id", "ord"])


def to_notes(docs: DataFrame, chapter: str = "", percent: float = 50.0) -> DataFrame:
    """(doc_id, notes): the significant sentences as note text, in parts of the coherence length."""
    body = F.translate("sentence", "()", "[]")
    s = significant(docs, percent).withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1)
    head = F.when(F.col("i") % COHERENCE == 0, F.concat(F.lit("\n :: part "), F.floor(F.col("i") / COHERENCE) + 1, F.lit(" ::\n"))).otherwise("")
    lines = s.select("doc_id", "ord", F.concat(head, F.lit("@sen"), "ord", F.lit("   "), body).alias("line"))
    text = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("t"), F.count("*").alias("n"))
    return text.select("doc_id", F.concat(F.lit(f"- {chapter or 'notes'}\n"), "t", F.lit("\n# sentences: "), "n", F.lit("\n")).alias("notes"))


# Fragments and n-grams

_BRACKET, _STOP = re.compile(r"[()\[\]{}]"), re.compile(r"['\"!.。]")


def balanced(s: str) -> list[str]:
    """Parts outside brackets and whole bracket groups."""
    s, pairs = s.strip(), {"(": ")", "[": "]", "{": "}"}
    out, start, waiting, depth = [], 0, "", {}
    for m in _BRACKET.finditer(s):
        i, c = m.start(), m[0]
        if c in pairs:
            depth[pairs[c]] = depth.get(pairs[c], 0) + 1
            if not waiting:
                waiting = pairs[c]
                if s[start:i].strip():
                    out.append(s[start:i].strip())
                start = i
        else:
            depth[c] = depth.get(c, 0) - 1
            if depth.get(waiting, 0) == 0:
                out.append(s[start : i + 1])
                start, waiting = i + 1, ""
    return out + ([s[start:].strip()] if s[start:].strip() else [])


def unbracket(s: str) -> tuple[str, bool]:
    if s and s[0] in "([{" and s[-1] == {"(": ")", "[": "]", "{": "}"}[s[0]]:
        return s[1:-1].strip(), True
    return s.strip(), False


def fragments(sentence: str) -> list[str]:
    """Parts between marks that white space follows; bracket groups stay whole."""
    out = []
    for part in balanced(sentence):
        inner, grouped = unbracket(part)
        out += [part] if grouped else [x.strip() for x in re.split(r'["—“”!?,:;]+[ \n]', inner) if len(x.strip()) > 1]
    return out


def even_quotes(s: str) -> str:
    return s + '"' * (s.count('"') % 2)


def paragraph_sentences(paragraph: str) -> list[str]:
    """Short paragraphs whole; others end at ! . or 。 outside quotes once there are more than 20 characters."""
    s = paragraph.translate(str.maketrans({"\n": " ", "\t": " ", "“": '"', "”": '"', "`": "'", "’": "'"})).strip()
    if len(s.encode()) < 100:
        return [even_quotes(s)] if s else []
    out, start, single, double = [], 0, False, False
    for m in _STOP.finditer(s):
        i, c = m.start(), m[0]
        single ^= c == "'"
        double ^= c == '"'
        if c in "!.。" and not single and not double and i + 1 - start > 20:
            out.append(even_quotes(s[start : i + 1]))
            start = i + 1
    return out + ([even_quotes(s[start:])] if start < len(s) else [])


def structure(text: str) -> list[list[list[str]]]:
    """Paragraphs, their sentences, and these' fragments of more than two bytes."""
    out = []
    for p in text.split("\n\n"):
        own = [[f for f in fragments(s) if len(f.strip().encode()) > 2] for s in paragraph_sentences(p.strip()) if s.strip()]
        if own:
            out.append(own)
    return out


_DASHES, _MARKS = re.compile(r"---.*"), re.compile(r'["—“”!?`,.:;()_]+')


def pure(s: str) -> str:
    """Without marks and what follows dashes, in lower case."""
    return _MARKS.sub("", _DASHES.sub("", s)).lower()


def clean_ngram(s: str) -> str:
    return pure(s).replace("  ", " ").strip("-").strip("'")


def excluded(first: str, last: str) -> bool:
    return min(len(first), len(last)) <= 2 or last.lower() in ENDINGS or first.lower() in STARTERS


def fragment_ngrams(fragment: str, least: int = 2, most: int = 5) -> list[tuple[int, str]]:
    """(n, n-gram) in the order in which they end."""
    w = fragment.split(" ")
    out = []
    for i in range(len(w)):
        for n in range(least, min(most, i + 1) + 1):
            part = w[i - n + 1 : i + 1]
            if not excluded(clean_ngram(part[0]), clean_ngram(part[-1])):
                out.append((n, clean_ngram(" ".join(part))))
    return out


def clean_ngrams(text: Column) -> Column:
    """clean_ngram() of a column."""
    bare = F.regexp_replace(F.regexp_replace(text, r"---.*", ""), r'["—“”!?`,.:;()_]+', "")
    return F.lower(F.btrim(F.btrim(F.replace(bare, F.lit("  "), F.lit(" ")), F.lit("-")), F.lit("'")))


def _spans(w: Column, starts: Column, ends: Column, most: int = 5) -> Column:
    """(n, ngram) of runs of 2 to `most` words that may stand alone, in the order in which they end. starts and ends say which words may be first and last."""

    def ending(i: Column) -> Column:
        n_of = F.filter(F.sequence(F.lit(2), F.lit(most)), lambda n: (n <= i) & F.get(ends, i - 1) & F.get(starts, i - n))
        return F.transform(n_of, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(w, i - n + 1, n), " ").alias("ngram")))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), ending))


def _exploded(rows: DataFrame, words: Column, keep: list[str]) -> DataFrame:
    """keep, pos, n and ngram of rows with a list of words."""
    of = rows.select(*keep, words.alias("w")).withColumn("c", F.transform("w", clean_ngrams))
    can = lambda banned: F.transform("c", lambda x: (F.length(x) > 2) & ~x.isin(*sorted(banned)))
    of = of.select(*keep, "w", can(STARTERS).alias("a"), can(ENDINGS).alias("b"))
    spans = of.select(*keep, F.posexplode(_spans(F.col("w"), F.col("a"), F.col("b"))).alias("pos", "x"))
    return spans.select(*keep, "pos", F.col("x.n").alias("n"), clean_ngrams(F.col("x.ngram")).alias("ngram"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _structured(texts: pd.Series) -> pd.Series:
    """The sentences of a text as lists of fragments; the only step that isn't an expression, since quotes and brackets need a memory."""
    return texts.map(lambda t: [s for p in structure(t) for s in p] if t else [])


def fragment_rows(docs: DataFrame, cleaned: bool = True) -> DataFrame:
    """(doc_id, l, sentence, frag, fragment): sentences count from 1, l is how many the document has. Documents are dealt out once; what follows is by document and stays there."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said outright, or few would be made of texts that are small beside their n-grams
    own = docs.select("doc_id", (clean(F.col("text")) if cleaned else F.col("text")).alias("text")).repartition(tasks, "doc_id")
    s = own.select("doc_id", _structured("text").alias("s"))
    # the number goes into each element, or else the whole list would be copied to each row for it
    s = s.select("doc_id", F.inline(F.transform("s", lambda f, i: F.struct(F.size("s").alias("l"), (i + 1).alias("sentence"), f.alias("f")))))
    return s.select("doc_id", "l", "sentence", F.posexplode("f").alias("frag", "fragment"))


def ngrams(docs: DataFrame) -> DataFrame:
    """(doc_id, l, sentence, frag, pos, n, ngram) for n of 2 to 5 from cleaned texts; sentences count from 1, l is how many there are."""
    return _exploded(fragment_rows(docs), F.split("fragment", " "), ["doc_id", "l", "sentence", "frag"])


def ngram_table(grams: DataFrame) -> DataFrame:
    """(doc_id, n, ngram, freq, locations)."""
    return grams.groupBy("doc_id", "n", "ngram").agg(F.count("*").cast("double").alias("freq"), F.array_sort(F.collect_list("sentence")).alias("locations"))


def gaps(grams: DataFrame) -> DataFrame:
    """(doc_id, n, ngram, occurrences, min_gap, max_gap) in sentences; the first gap is from 0, the least starts at 99."""
    last = F.lag("sentence", 1, 0).over(Window.partitionBy("doc_id", "n", "ngram").orderBy("sentence"))
    own = grams.withColumn("gap", F.col("sentence") - last)
    return own.groupBy("doc_id", "n", "ngram").agg(F.count("*").alias("occurrences"), F.least(F.lit(99), F.min("gap")).alias("min_gap"), F.max("gap").alias("max_gap"))


def intentional(gap: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds whether an n-gram is intended: in short documents, once only, or with widely spread gaps. lengths has (doc_id, l)."""
    rule = (F.col("l") < COHERENCE) | (F.col("occurrences") < 2) | (F.col("max_gap") > F.col("min_gap") + COHERENCE)
    return gap.join(lengths, "doc_id").withColumn("intentional", (F.col("n") > 1) & rule)


def lengths(grams: DataFrame) -> DataFrame:
    """(doc_id, l): the number of sentences, with n-grams or without."""
    return grams.groupBy("doc_id").agg(F.max("l").alias("l"))


def intents(grams: DataFrame, freq: DataFrame) -> DataFrame:
    """Adds the score of n-grams(doc_id, n, ngram): the static scores of the n-grams inside by their frequency, (doc_id, n, ngram, freq), for the same number of words."""
    inside = _exploded(grams.withColumnsRenamed({"n": "of_n", "ngram": "of"}), F.split("of", " "), ["doc_id", "of_n", "of"])
    own = inside.join(freq, ["doc_id", "n", "ngram"], "left").groupBy("doc_id", "of_n", "of").agg(F.sum(static_score(F.col("ngram"), F.coalesce("freq", F.lit(0)))).alias("score"))
    own = own.withColumnsRenamed({"of_n": "n", "of": "ngram"})
    return grams.join(own, ["doc_id", "n", "ngram"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def anomalies(grams: DataFrame) -> DataFrame:
    """(doc_id, n, kind, ngram, score, rank): the best intended and ambient n-grams, as many as CAPS allows for their n."""
    table = grams.groupBy("doc_id", "n", "ngram").agg(F.count("*").alias("freq"))
    score = intents(table.select("doc_id", "n", "ngram"), table)
    kinds = intentional(gaps(grams), lengths(grams)).select("doc_id", "n", "ngram", F.when(F.col("intentional"), "intent").otherwise("context").alias("kind"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "n", "kind").orderBy(F.round("score", 6).desc(), "ngram"))
    cap = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])
    return score.join(kinds, ["doc_id", "n", "ngram"]).withColumn("rank", rank).where(F.col("rank") <= cap[F.col("n")]).select("doc_id", "n", "kind", "ngram", "score", "rank")


def partitions(grams: DataFrame) -> DataFrame:
    """(doc_id, m, n, p, ngram, count) by stretches of the coherence length, the last one capped; m is how many there are."""
    m = F.floor(F.col("l") / COHERENCE).cast("int") + 1
    p = F.least(F.floor(F.col("sentence") / COHERENCE).cast("int") + 1, m)
    return grams.groupBy("doc_id", m.alias("m"), "n", p.alias("p"), "ngram").agg(F.count("*").alias("count"))


def fast_slow(grams: DataFrame) -> DataFrame:
    """(doc_id, n, p, ngram, slow): n-grams of a stretch that the next one has too are slow, the others fast; one stretch is fast."""
    nxt = F.lead("p").over(Window.partitionBy("doc_id", "n", "ngram").orderBy("p"))
    own = partitions(grams).withColumn("slow", F.coalesce(nxt == F.col("p") + 1, F.lit(False)))
    return own.where((F.col("p") < F.col("m")) | (F.col("m") == 1)).select("doc_id", "n", "p", "ngram", "slow")


def coactivation(grams: DataFrame) -> DataFrame:
    """(doc_id, n, ngram, overlap, condensate): in how many pairs of stretches an n-gram is in both, or, for one that is in one stretch only, how many stretches follow.

    One that is only in the last stretch has no row. Of a single stretch everything overlaps once.
    """
    own = partitions(grams).groupBy("doc_id", "m", "n", "ngram").agg(F.count("*").alias("k"), F.min("p").alias("p"))
    overlap = F.when(F.col("m") < 2, 1).otherwise(F.floor(F.col("k") * (F.col("k") - 1) / 2)).cast("bigint")
    own = own.select("doc_id", "n", "ngram", overlap.alias("overlap"), F.when(overlap > 0, 0).otherwise(F.col("m") - F.col("p")).cast("bigint").alias("condensate"))
    return own.where("overlap > 0 or condensate > 0")


def intentional_tokens(grams: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(doc_id, p, n, kind, ngram, score, rank): the best fast and slow n-grams of each stretch, and with p = 0 those of the whole document.

    The document's are those of its stretches with a score above 1; a slow one isn't fast as well. With
    selected(doc_id, fragment), every selected fragment of the document has them inside; stretches aren't filtered.
    """
    freq = grams.groupBy("doc_id", "n", "ngram").agg(F.count("*").alias("freq"))
    own = fast_slow(grams).join(freq, ["doc_id", "n", "ngram"]).withColumn("score", static_score(F.col("ngram"), F.col("freq")))
    own = own.withColumn("kind", F.when(F.col("slow"), "slow").otherwise("fast"))
    best = lambda *by: F.row_number().over(Window.partitionBy("doc_id", *by).orderBy(F.round("score", 6).desc(), "ngram"))
    names = ["doc_id", "p", "n", "kind", "ngram", "score", "rank"]
    parts = own.withColumn("rank", best("p", "n", "kind")).where(F.col("rank") <= SKIM).select(*names)
    whole = parts.where("score > 1").groupBy("doc_id", "n", "ngram").agg(F.max("kind").alias("kind"), F.first("score").alias("score"))
    if selected is not None:
        missing = whole.join(selected.select("doc_id", "fragment"), "doc_id").where(~F.contains("fragment", F.col("ngram"))).select("doc_id", "n", "ngram").distinct()
        whole = whole.join(missing, ["doc_id", "n", "ngram"], "left_anti")
    whole = whole.withColumn("p", F.lit(0)).withColumn("rank", best("n", "kind")).where(F.col("rank") <= SKIM)
    return parts.unionAll(whole.select(*names))


def running_ngram_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, score) of fragments in order: a new n-gram sets the score to its length, a known one adds what it has decayed."""
    rows = fragment_rows(docs, cleaned=False)
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence", "frag")))
    grams = _exploded(rows, F.split("fragment", " "), ["doc_id", "ord"])
    last = F.lag("ord").over(Window.partitionBy("doc_id", "n", "ngram").orderBy("ord", "pos"))
    grams = grams.withColumn("last", last)
    new = F.max(F.when(F.col("last").isNull(), F.col("pos"))).over(Window.partitionBy("doc_id", "ord"))
    size = F.length("ngram")
    own = F.when(F.col("last").isNull(), size).otherwise(size * (1 - F.exp(-(F.col("ord") - F.col("last")) / F.lit(float(COHERENCE)))))
    score = grams.withColumn("new", new).where("new is null or pos >= new").groupBy("doc_id", "ord").agg(F.sum(own).alias("score"))
    return rows.select("doc_id", "ord").join(score, ["doc_id", "ord"], "left").select("doc_id", "ord", F.coalesce("score", F.lit(0.0)).alias("score"))


# Entities and links

_CALENDAR = {m.lower() for m in "January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec Monday Tuesday Wednesday Thursday Friday Saturday Sunday Mon Tue Wed Thu Fri Sat Sun".split()}
_RELATIONS = [
    ("then", 1, 0.7, r"cause|causes|lead\s+to|leads\s+to|result\s+in|results\s+in|triggers?|before|after|then|followed\s+by"),
    ("contain", 2, 0.7, r"contains?|includes?|has|consists?\s+of"),
    ("note", 3, 0.6, r"is|means?|represents?|describes?"),
    ("ll", 0, 0.6, r"like|similar\s+to|near|resembles?"),
]
_BETWEEN = [(arrow, st, sure, re.compile(rf"\b(?:{words_})\b", re.I)) for arrow, st, sure, words_ in _RELATIONS]
_ANY_BETWEEN = re.compile(rf"\b(?:{'|'.join(words_ for _, _, _, words_ in _RELATIONS)})\b", re.I)
_LETTERS = re.compile(r"[a-z]+")


def find_entities(text: str) -> list[tuple[str, str, float, int, int]]:
    """(text, kind, confidence, start, end) by passes from sure to unsure; a text is found once. Ends are exclusive, from 0."""
    out, seen = [], set()
    starts = {k + d for k in [0] + [m.end() for m in re.finditer(r"[!?.]\s+", text)] for d in (-1, 0, 1)}

    def add(key: str, kind: str, sure: float, a: int, b: int) -> None:
        if key not in seen:
            seen.add(key)
            out.append((key, kind, sure, a, b))

    for m in re.finditer(r"\b\d{4}(?:[/-]\d\d?){2}\b", text):
        add(m[0], "event", 0.9, *m.span())
    for m in re.finditer(r'"([^"]+)"', text):
        add(m[1], "concept", 0.8, *m.span())
    if not _CALENDAR.isdisjoint(_LETTERS.findall(text.lower())):
        for m in re.finditer(r"\b[A-Za-z]+\b", text):
            if m[0].lower() in _CALENDAR:
                add(m[0], "event", 0.7, *m.span())
    for m in re.finditer(r"[A-Z](?<!\w.)[a-z]{2,}\b", text):
        if m.start() not in starts and m[0].lower() not in _CALENDAR:
            add(m[0], "person", 0.6, *m.span())
    for m in re.finditer(r"\b[a-z]+(?:ment|ness|tion)\b", text, re.I):
        add(m[0].lower(), "concept", 0.5, *m.span())
    for m in re.finditer(r"\b(?:an?|the)\s+([a-z]\w+)", text, re.I):
        add(m[1].lower(), "thing", 0.4, *m.span())
    return out


def relation(between: str) -> tuple[str, int, float]:
    for arrow, st, sure, words_ in _BETWEEN if _ANY_BETWEEN.search(between) else ():
        if words_.search(between):
            return arrow, st, sure
    return "ll", 0, 0.3


def suggest(text: str, found: list[tuple[str, str, float, int, int]]) -> list[tuple[str, str, str, int, float]]:
    """(source, target, arrow, type, confidence) between entities that follow each other, by the words between."""
    own = sorted(found, key=lambda e: e[3])
    return [(a[0], b[0], *relation(text[a[4] : b[3]])) for a, b in zip(own, own[1:]) if a[4] < b[3]]


def _dealt(docs: DataFrame) -> DataFrame:
    """Texts dealt out to all tasks; a file may come as a single part."""
    return docs.select("doc_id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, text, entity_type, confidence, span)."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(d, *e[:3], {"start": e[3], "end": e[4]}) for d, t in zip(frame["doc_id"], frame["text"]) for e in find_entities(t or "")]
            yield pd.DataFrame(out, columns=["doc_id", "text", "entity_type", "confidence", "span"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _dealt(docs).mapInPandas(run, f"doc_id {kind}, text string, entity_type string, confidence double, span struct<start:int,end:int>")


def suggested_links(docs: DataFrame) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(d, *x) for d, t in zip(frame["doc_id"], frame["text"]) for x in suggest(t or "", find_entities(t or ""))]
            yield pd.DataFrame(out, columns=["doc_id", "source", "target", "arrow", "sttype", "confidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _dealt(docs).mapInPandas(run, f"doc_id {kind}, source string, target string, arrow string, sttype int, confidence double")


def breakdown_notes(text: str, chapter: str = "default") -> str:
    """Entities and suggested links of a text as note text."""
    found = find_entities(text)
    label = {e[0]: f"@e{k}" for k, e in enumerate(found, 1)}
    lines = [f" - {chapter}", ""] + [f"{label[e[0]]}   {e[0]}" for e in found] + [""] * bool(found)
    lines += [f'{label.get(a, a)}  " ({arrow}) {label.get(b, b)}' for a, b, arrow, _, _ in suggest(text, found)]
    return "\n".join(lines) + "\n"
