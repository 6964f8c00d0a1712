"""Document search: postings, staged lexical matching, BM25, vectors, hybrid fusion, diversification, names."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import AMOUNT, fold_ascii, fold_text, identifier_variants, index_tokens, words

#: Words that say nothing about what is sought (fixed values).
GENERIC = ("tim", "kiem", "tìm", "kiếm", "file", "files", "document", "documents", "doc", "in", "of", "the", "a", "an", "to", "for", "co", "có", "ve", "về",
           "trong", "la", "là", "noi", "dung", "nội", "giup", "giúp", "hay", "show")

#: Words of a question that say nothing about a file's name: with their accents, without, and in pairs (fixed values).
FILLER_ACCENTED = tuple((
    "có cái nào là không cho của những một các tôi mình giúp hãy tìm kiếm này kia được đâu gì và "
    "với trong trên về thì sao nhỉ nhé vậy nè rồi chưa hoặc từ đến ở mà để khi xem ông").split())
FILLER_PLAIN = tuple((
    "co cai nao la khong cho cua nhung mot cac nay kia duoc gi va voi trong tren thi sao nhi nhe "
    "vay ne roi chua hoac xem tim kiem giup hay file files the of in is are any there find show "
    "search please which what where a an to for with or and ong").split())
FILLER_PAIRS = r"\b(?:tài liệu|tai lieu|văn bản|van ban|nội dung|noi dung)\b"


def is_filler(word: Column) -> Column:
    """Whether a lower-case word says nothing about a name. It is judged as typed: "mỹ" isn't taken for "my", which folding would make of it."""
    return word.isin(*FILLER_ACCENTED) | (word.isin(*FILLER_PLAIN) & (fold_ascii(word) == word))


def name_words(question: Column, fillers: bool = False) -> Column:
    """The different folded words of a question that a file's name may have, without fillers unless asked for; null question: null.

    For a question of fillers only the list is empty, and the one with fillers is what can be sought.
    """
    typed = F.filter(F.split(F.regexp_replace(F.lower(question), FILLER_PAIRS, " "), r"[^\p{L}\p{N}\p{M}]+"), lambda t: t != "")
    kept = typed if fillers else F.filter(typed, lambda t: ~is_filler(t))
    return F.array_distinct(F.filter(F.transform(kept, fold_ascii), lambda t: t != ""))


def parse_query(text: str) -> dict[str, list[dict]]:
    """Terms of a query: blanks separate, quotes keep a phrase, a leading minus excludes; `prefix` is a word still being typed."""
    out: dict[str, list[dict]] = {"include": [], "exclude": []}
    for minus, quoted, bare in re.findall(r'(-)?(?:"([^"]*)"|(\S+))', text):
        raw = (quoted or bare).strip()
        tokens = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", raw).lower())
        if tokens:
            out["exclude" if minus else "include"].append({"tokens": tokens, "prefix": bool(bare) and len(tokens[-1]) >= 2})
    return out


def query_tokens(text: str) -> list[str]:
    """Folded words without generic ones, unless nothing would remain; grouped amounts are joined to their digits."""
    joined = re.sub(AMOUNT, lambda m: re.sub(r"\D", "", m[0]) if len(re.sub(r"\D", "", m[0])) <= 15 else m[0], unicodedata.normalize("NFKC", text))
    every = fold_text(joined).split()
    kept = [t for t in every if t not in GENERIC]
    return kept or every


def is_short(text: str) -> bool:
    """At most four words, or any digit: such queries trust exact hits."""
    return len(query_tokens(text)) <= 4 or any(c.isdigit() for c in text)


def one_edit(word: Column, term: str, least: int = 4) -> Column:
    """Whether a word is the term, or differs by one letter put in, left out or changed; words and terms under `least` letters must be equal."""
    return (word == term) | (F.lit(len(term) >= least) & (F.length(word) >= least) & (F.levenshtein(word, F.lit(term), 1) >= 0))


def freshest(df: DataFrame, names: Sequence[str], fresh: Column, id_col: str) -> DataFrame:
    """(names, id): of rows with equal names the freshest, and of equally fresh ones the smallest id. A row without a date is the oldest."""
    return df.groupBy(*names).agg(F.max_by(id_col, F.struct(fresh.isNotNull(), fresh, -F.col(id_col))).alias(id_col))


def postings(df: DataFrame, id_col: str, text: str, tokens=words) -> DataFrame:
    """(term, id, tf, len): one row for each term and document; counted map-side before the shuffle.

    A text is cut into words once and its length taken before they are unfolded, so that the array isn't carried along with each.
    """
    rows = df.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("_words")).withColumn("len", F.size("_words"))
    each = rows.select("id", "len", F.explode("_words").alias("term"))
    return each.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"))


def _count_of(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == term))


def _has_any(array: Column | str, terms: Sequence[str]) -> Column:
    return F.exists(array, lambda x: x.isin(*terms))


def _starts(array: Column, term: str) -> Column:
    return F.exists(array, lambda t: t.startswith(term))


def _near(array: Column, term: str) -> Column:
    return F.exists(array, lambda t: F.levenshtein(t, F.lit(term), 1) >= 0)


def bm25(df: DataFrame, id_col: str, text: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score, matched): the published formula over whole-table statistics.

    Counts of the few asked terms are taken inside each row. One row of totals comes to the driver, and nothing is shuffled.
    """
    t = list(dict.fromkeys(terms))
    rows = df.select(F.col(id_col).alias("id"), words(F.col(text)).alias("w"))
    rows = rows.select("id", F.size("w").alias("len"), *(_count_of("w", q).alias(f"tf{i}") for i, q in enumerate(t)))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(t)))).first()
    hit = rows.where(" OR ".join(f"tf{i} > 0" for i in range(len(t))))
    idf = [math.log(1 + (total.n - total[f"df{i}"] + 0.5) / (total[f"df{i}"] + 0.5)) for i in range(len(t))]

    def part(i: int) -> Column:
        tf = F.col(f"tf{i}")
        return F.when(tf > 0, F.lit(idf[i]) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(float(total.avg or 1))))).otherwise(0.0)

    return hit.select("id", sum((part(i) for i in range(len(t))), F.lit(0.0)).alias("score"), sum(((F.col(f"tf{i}") > 0).cast("int") for i in range(len(t))), F.lit(0)).alias("matched"))


def staged(df: DataFrame, id_col: str, text: str, query: str) -> DataFrame:
    """(id, stage): 0 the phrase, 1 all words, 2 any word. One pass gives the strongest stage of each row."""
    tokens = query_tokens(query)
    w = words(F.col(text))
    has = [_has_any("w", identifier_variants(q)) for q in tokens]
    phrase = F.contains(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")), F.lit(f" {' '.join(tokens)} "))
    every, some = has[0], has[0]
    for h in has[1:]:
        every, some = every & h, some | h
    rows = df.select(F.col(id_col).alias("id"), w.alias("w"))
    return rows.select("id", F.when(phrase, 0).when(every, 1).when(some, 2).alias("stage")).where("stage IS NOT NULL")


def boolean(post: DataFrame, include: Sequence[str], exclude: Sequence[str], join: str = "and") -> DataFrame:
    """Ids of a postings table with all (or any) of the terms and none of the excluded."""
    hit = post.where(F.col("term").isin(*include)).groupBy("id").agg(F.count_distinct("term").alias("n"))
    hit = hit.where(F.col("n") >= (len(set(include)) if join == "and" else 1)).select("id")
    return hit.join(post.where(F.col("term").isin(*exclude)).select("id").distinct(), "id", "left_anti") if exclude else hit


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for a vector without length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def vector_search(df: DataFrame, id_col: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """Exact top k by cosine: a projection and a bounded heap in each task; non-finite scores drop."""
    scored = df.select(F.col(id_col), cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))).alias("score"))
    return scored.where(~F.isnan("score")).orderBy(F.desc("score"), id_col).limit(k)


def unit(v: Column) -> Column:
    """The vector at length 1, or as it is without length. In a lambda the length has a name, so it is computed once and not for each number."""
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))), F.lit(0))


def truncated(v: Column, dims: int) -> Column:
    """Unit vector, its first dimensions, and those as a unit vector again."""
    return unit(F.slice(unit(v), 1, dims))


def merged_vectors(a: Column, b: Column) -> Column:
    return unit(F.zip_with(a, b, lambda x, y: x + y))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set, then a unit vector; array<array<double>> and array<int>."""
    kept = F.transform(F.filter(F.zip_with(tokens, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda s: s["m"] > 0), lambda s: s["v"])
    total = F.aggregate(F.slice(kept, 2, 1 << 20), F.get(kept, F.lit(0)), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return unit(F.transform(total, lambda x: x / F.size(kept)))


def quantized(v: Column) -> Column:
    """struct(scale, q): 8-bit codes with scale max / 127, rounded half up, within -127..127."""
    scale = (F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127).cast("float")
    step = F.when(scale > 0, scale.cast("double")).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / step + 0.5))).cast("byte")).alias("q"))


def space_id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def fuse(lexical: DataFrame, semantic: DataFrame, query: str | None = None, strong: bool = False, gate: bool = True) -> DataFrame:
    """(chunk_id, document_id, score, order_score) of two ranked lists (chunk_id, document_id, rank, strict).

    Reciprocal ranks weigh 2 : 1, or 1 : 2 for long queries and a strong model. One to three strict hits of a short query are pinned first.
    """
    short = query is None or is_short(query)
    a, b = (1.0, 2.0) if not short and strong else (2.0, 1.0)
    each = lexical.select("chunk_id", "document_id", (F.lit(a) / (60 + F.col("rank"))).alias("s"), F.when(F.col("strict"), F.col("rank")).alias("strict_rank")).unionByName(
        semantic.select("chunk_id", "document_id", (F.lit(b) / (60 + F.col("rank"))).alias("s"), F.lit(None).cast("int").alias("strict_rank")))
    out = each.groupBy("chunk_id").agg(F.min("document_id").alias("document_id"), F.sum("s").alias("score"), F.min("strict_rank").alias("_strict"))
    gated = gate and query is not None and short and 1 <= lexical.where("strict").limit(4).count() <= 3
    pinned = F.when(F.lit(gated) & F.col("_strict").isNotNull(), 1000.0 - (F.col("_strict") - 1)).otherwise(0.0)
    return out.select("chunk_id", "document_id", "score", (F.col("score") + pinned).alias("order_score"))


def diversify(df: DataFrame, most: int = 2, limit: int = 8) -> DataFrame:
    """At most `most` chunks a document in order of order_score, then the others up to `limit`."""
    w = Window.partitionBy("document_id").orderBy(F.desc("order_score"), "chunk_id")
    ranked = df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)
    return ranked.orderBy((F.col("nth") > most).cast("int"), F.desc("order_score"), "chunk_id").limit(limit).select("chunk_id", "document_id", "score", "nth")


def promote_names(names: DataFrame, content: DataFrame, most_new: int = 3) -> DataFrame:
    """(document_id, place): documents found by name first, of which at most `most_new` aren't in the content hits, then content hits in order."""
    both = names.select("document_id", F.col("rank").alias("name_rank")).join(content.select("document_id", F.col("rank").alias("content_rank")), "document_id", "full_outer")
    only = both.where("content_rank IS NULL").orderBy("name_rank").limit(most_new)
    kept = both.where("content_rank IS NOT NULL").unionByName(only)
    return kept.select("document_id", F.when(F.col("name_rank").isNotNull(), F.col("name_rank")).otherwise(1_000_000 + F.col("content_rank")).alias("place"))


def name_score(folded_name: Column, folded_parent: Column, query_words: Sequence[str], minimum: int = 1) -> Column:
    """Score of a folded file name: 140 exact, 130 prefix, 115 joined inside, 110 and more all words, 90 and more with typos, else a share of 50."""
    q, joined_q, n = " ".join(query_words), "".join(query_words), len(query_words)
    joined = F.replace(folded_name, F.lit(" "), F.lit(""))
    name_tokens = F.filter(F.split(folded_name, " "), lambda x: x != "")
    tokens = F.concat(name_tokens, F.filter(F.split(folded_parent, " "), lambda x: x != ""))
    kinds = []
    for w in query_words:
        exact = F.array_contains(tokens, w)
        prefix = ~exact & _starts(tokens, w)
        typo = F.lit(len(w) >= 4) & ~exact & ~prefix & _near(tokens, w)
        kinds.append((exact, prefix, typo))
    exact, prefix, typo = (sum((k[i].cast("int") for k in kinds), F.lit(0)) for i in range(3))
    matched = exact + prefix + typo
    cover = F.size(F.filter(name_tokens, lambda t: t.isin(*query_words))) / n
    return (F.when((folded_name == q) | (joined == joined_q), 140.0).when(folded_name.startswith(q) | joined.startswith(joined_q), 130.0).when(F.contains(joined, F.lit(joined_q)), 115.0)
            .when(matched < minimum, 0.0).when((matched == n) & (typo == 0), 110 + exact / n * 5 + cover).when(matched == n, 90 + exact / n * 5 + prefix / n * 2)
            .otherwise(matched / n * 50 + exact * 0.01 + prefix * 0.001))


def matched_words(folded: Column, query_words: Sequence[str]) -> Column:
    """How many words a folded name has: whole, as a part from three letters on, as a code with other leading zeros, or joined with a neighbour."""
    from ..functions.text import canonical_identifier

    have, joined = F.split(folded, " "), F.replace(folded, F.lit(" "), F.lit(""))
    codes = F.transform(have, canonical_identifier)
    canon = [re.sub(r"^([a-z]+)0+(?=\d)", r"\1", w) if re.fullmatch(r"[a-z]+\d+", w) else w for w in query_words]
    inside = [F.contains(joined, F.lit(a + b)) for a, b in zip(query_words, query_words[1:], strict=False)]
    found = []
    for i, w in enumerate(query_words):
        ok = F.array_contains(have, w) | (F.lit(bool(re.fullmatch(r"[a-z]+\d+", w))) & F.array_contains(codes, canon[i])) | (F.lit(len(w) >= 3) & F.contains(joined, F.lit(w)))
        for near in inside[max(0, i - 1):i + 1]:
            ok = ok | near
        found.append(ok.cast("int"))
    return sum(found, F.lit(0))


def name_aliases(query_words: Sequence[str]) -> list[list[str]]:
    """A controlled synonym, as another query and not as more words: 'ra vien' and 'xuat vien'."""
    w = list(query_words)
    if "vien" not in w or ("ra" in w) == ("xuat" in w):
        return []
    return [[{"ra": "xuat", "xuat": "ra"}.get(x, x) for x in w]]


def best_per_key(df: DataFrame, key: str, score: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(score).alias(score), F.max_by(value, score).alias(value))


def rerank(df: DataFrame, external: str, order: str) -> DataFrame:
    """By an outside score, best first, then the local order; rows without a score keep that order behind the others."""
    return df.orderBy(*rerank_keys(external, order))


def rerank_keys(external: str, order: str) -> list[Column]:
    """Sort keys of `rerank`."""
    return [F.col(external).desc_nulls_last(), F.col(order)]


#: Words that name a kind of file (fixed values).
KINDS = {"photo": "image", "photos": "image", "image": "image", "images": "image", "picture": "image", "pictures": "image", "video": "video", "videos": "video", "clip": "video", "movie": "video"}


def media_intent(text: str) -> dict:
    """Kind, half-open date range and remaining words of a media query: yyyy-mm-dd, dd/mm/yyyy, mm/yyyy, yyyy-mm, yyyy, or month names."""
    import datetime as dt

    months = {m: i + 1 for i, m in enumerate(("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"))}
    out: dict = {"kind": None, "from": None, "to": None, "words": []}

    def span(y: int, m: int | None = None, d: int | None = None) -> None:
        start = dt.date(y, m or 1, d or 1)
        end = start + dt.timedelta(1) if d else dt.date(y + (m == 12 or not m), (m % 12) + 1 if m else 1, 1)
        out["from"], out["to"] = start, end

    rest = text.lower()
    for pattern, take in ((r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", lambda m: span(int(m[1]), int(m[2]), int(m[3]))), (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", lambda m: span(int(m[3]), int(m[2]), int(m[1]))),
                          (r"\b(\d{1,2})/(\d{4})\b", lambda m: span(int(m[2]), int(m[1]))), (r"\b(\d{4})-(\d{1,2})\b", lambda m: span(int(m[1]), int(m[2]))),
                          (rf"\b({'|'.join(months)})\s+(\d{{4}})\b", lambda m: span(int(m[2]), months[m[1]])), (r"\b((?:19|20)\d\d)\b", lambda m: span(int(m[1])))):
        m = re.search(pattern, rest)
        if m:
            try:
                take(m)
            except ValueError:
                continue
            rest = rest[:m.start()] + " " + rest[m.end():]
            break
    for w in rest.split():
        if w in KINDS and not out["kind"]:
            out["kind"] = KINDS[w]
        else:
            out["words"].append(w)
    return out


def media_search(df: DataFrame, intent: dict, kind: str, at: str, name: str, limit: int) -> DataFrame:
    """Rows of a kind in a date range whose name has all words, newest first."""
    if intent["kind"]:
        df = df.where(F.col(kind) == intent["kind"])
    if intent["from"]:
        df = df.where((F.col(at) >= F.lit(intent["from"])) & (F.col(at) < F.lit(intent["to"])))
    for w in intent["words"]:
        df = df.where(F.contains(F.lower(F.col(name)), F.lit(w)))
    return df.orderBy(F.col(at).desc(), name).limit(limit)
