"""Line dedup by winnowing: window minima over line hashes find shared passages, which are extended to whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, once, settle, written

#: A run of equal lines is removed from this many words on.
LEAST_WORDS = 40
_MARK = "\x01"
#: The columns that are added.
ADDED = ("n_lines_removed", "removed")


def lines(text: Column) -> Column:
    """The text cut after each line feed and each sentence end that a space follows; joined again, it's the text.

    Passages that are copied into a line start and end at sentences, so the unit is finer than a printed line.
    Texts that hold the mark itself are cut by a regular expression, to the same effect.
    """
    marked = text
    for end in ("\n", ". ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, r"(?<=\n|\. |\? )")).otherwise(F.split(marked, _MARK))


def stripped(text: Column) -> Column:
    """The `lines` of a text without the white space at their ends.

    Texts without tabs and the like are cut at line feeds and the spaces behind sentences, so that only spaces are left to take off:
    `btrim` with a set of characters makes a list of all places of a line.
    """
    marked, odd = F.replace(text, F.lit("\n"), F.lit(_MARK)), F.contains(text, F.lit(_MARK))
    for end in ".?":
        marked = F.replace(marked, F.lit(f"{end} "), F.lit(end + _MARK))
    for space in "\t\x0b\x0c\r":
        odd |= F.contains(text, F.lit(space))
    whole = F.transform(lines(text), lambda p: F.btrim(p, F.lit(" \t\n\x0b\x0c\r")))
    return F.when(odd, whole).otherwise(F.transform(F.split(marked, _MARK), lambda p: F.trim(p)))


def hashed(docs: DataFrame) -> DataFrame:
    """(id, x, n: number of lines, place and hw: places and hashes of the lines with words, w0: their words).

    White space at the ends of a line doesn't count. Blank lines are all alike, so their numbers, which the places tell, are enough.
    """
    d = docs.select("id", "x", stripped(F.col("text")).alias("parts"))
    told = F.transform("parts", lambda p, i: F.when(p != "", F.struct(
        i.alias("i"), F.xxhash64(p).alias("h"), (F.octet_length(p) - F.octet_length(F.replace(p, F.lit(" "), F.lit(""))) + 1).alias("w"))))
    d = d.select("id", "x", F.size("parts").alias("n"), F.filter(told, lambda t: t.isNotNull()).alias("told"))
    return d.select("id", "x", "n", F.col("told.i").alias("place"), F.col("told.h").alias("hw"), F.col("told.w").alias("w0"))


def sums(rows: DataFrame, least_words: int) -> DataFrame:
    """`rows` with `sums`: (gap, w) for gaps that are powers of two, from the largest; w has the words of each `gap` lines together.

    Sums only grow with the gap. Once all of a text's have `least_words`, no such gap can be stepped over, so it and larger ones are left out.
    """
    d = rows
    gaps = [1 << k for k in range((least_words - 1).bit_length())]
    for k, gap in enumerate(gaps[:-1]):
        n = F.size(f"w{k}") - gap
        two = F.zip_with(F.slice(f"w{k}", F.lit(1), n), F.slice(f"w{k}", F.lit(gap + 1), n), lambda a, b: a + b)
        d = d.withColumn(f"w{k + 1}", F.when((n > 0) & (F.array_min(f"w{k}") < least_words), two).otherwise(F.array().cast("array<int>")))
    every = F.array(*(F.struct(F.lit(gap).alias("gap"), F.col(f"w{k}").alias("w")) for k, gap in reversed([*enumerate(gaps)])))
    return d.select("id", "x", "n", "place", "hw", "w0", F.filter(every, lambda s: F.array_min(s["w"]) < least_words).alias("sums"))


def fingerprints(rows: DataFrame, least_words: int) -> DataFrame:
    """(id, x, m, q, u, hw, pl, runs): the winnowed fingerprints of `hashed` rows, and the windows that each was selected in.

    Lines with words are numbered apart from blank ones. The windows are the least removable runs: one from line r on ends at the
    first line s with which it has `least_words` words; further ones end later, and would have too few words without their first
    line. Every run with enough words is the union of the windows in it: a line with enough words before it in the run ends a
    window, any other is in the window from the run's first line on. There are at most twice as many windows as lines.
    The shortest window of a line may have 0 to `lead` of the blank lines before it, a longer one 0 to `trail` of those after it.

    Each window selects its least line hash (the first of equals), as fingerprint m at line q. That depends on nothing outside of
    the window, so equal windows select equal fingerprints: if a run stands twice, its windows' fingerprints do.
    `runs` has (r, s, lead, trail) of the windows, `hw` the hashes of their lines, from line u on, and `pl` the places of those lines
    with that of one line more at either end (-1 and n beyond the text).
    """
    # The most lines that have fewer than `least_words` together are stepped over, by powers of two; the next one is the end.
    d = sums(rows, least_words)

    def over(acc: Column, s: Column) -> Column:
        words = acc["words"] + F.get(s["w"], acc["at"])
        return F.when(words < least_words, F.struct((acc["at"] + s["gap"]).alias("at"), words.alias("words"))).otherwise(acc)

    # Arrays that a lambda takes from outside are named twice on purpose: Catalyst then computes them once and doesn't put them into it.
    start = lambda r: F.struct(r.alias("at"), F.lit(0).alias("words"))
    d = d.withColumn("last", F.when(F.size("sums") >= 0, F.transform("w0", lambda w, r: F.aggregate("sums", start(r), over, lambda acc: acc["at"]))))
    edged = F.concat(F.array(F.lit(-1)), "place", F.array("n"))
    d = d.select("id", "x", "hw", edged.alias("pl"), F.filter("last", lambda s: s < F.size("hw")).alias("ends"))

    def windows(s: Column, r: Column) -> Column:
        after = F.coalesce(F.get("ends", r + 1), F.size("hw"))
        return F.transform(F.sequence(s, F.greatest(s, after - 1)), lambda t: F.struct(
            r.alias("r"), t.alias("s"),
            F.when(t == s, F.get("pl", r + 1) - F.get("pl", r) - 1).otherwise(0).alias("lead"),
            F.when(t < after, F.get("pl", t + 2) - F.get("pl", t + 1) - 1).otherwise(0).alias("trail")))

    d = d.select("id", "x", "hw", "pl", F.flatten(F.transform("ends", windows)).alias("b"))
    least = lambda q, k: F.when(F.get("hw", k) < F.get("hw", q), k).otherwise(q)
    line = lambda y: F.aggregate(F.sequence(y["r"], y["s"]), y["r"], least)
    d = d.select("id", "x", "hw", "pl", "b", F.when(F.size("hw") >= 0, F.transform("b", line)).alias("q"))
    # Starts and ends of the windows only grow, and so does the line of their first minimum: its windows stand together.
    new = F.filter(F.transform("q", lambda q, i: F.when((i == 0) | (F.get("q", i - 1) != q), i)), lambda i: i.isNotNull())
    d = d.select("id", "x", "hw", "pl", "b", "q", new.alias("new"))

    def mark(k: Column, i: Column) -> Column:
        end = F.coalesce(F.get("new", i + 1), F.size("b"))
        u, last = F.get("b", k)["r"], F.get("b", end - 1)["s"]
        part = lambda c, first, to: F.transform(F.sequence(first, to), lambda j: F.get(c, j))
        return F.struct(F.get("hw", F.get("q", k)).alias("m"), F.get("q", k).alias("q"), u.alias("u"),
                        part("hw", u, last).alias("hw"), part("pl", u, last + 2).alias("pl"), part("b", k, end - 1).alias("runs"))

    d = d.select("id", "x", F.explode(F.transform("new", mark)).alias("f"))
    return d.select("id", "x", "f.*")


def extended(pairs: DataFrame) -> DataFrame:
    """(id, x, at, to, rest) of places of a fingerprint that are `pairs` with its first place `f`: matches extended both ways.

    From the fingerprint, lines are compared with those at the first place while hashes and numbers of blank lines between agree, as
    far as both have windows. `at` and `to` are the first and last place of the windows in the matching stretch, with the blank lines that both
    have at its ends (null if no window is in it); `rest` has hash and places of the windows that aren't.
    """
    i, j = F.col("q") - F.col("u"), F.col("fq") - F.col("fu")
    d = pairs.select("id", "x", "q", "u", "hw", "pl", "runs", F.col("f.q").alias("fq"), F.col("f.u").alias("fu"), F.col("f.hw").alias("fh"), F.col("f.pl").alias("fp"))
    step = lambda pl: F.transform(F.sequence(F.lit(0), F.size(pl) - 2), lambda k: F.get(pl, k + 1) - F.get(pl, k))
    d = d.select("*", i.alias("i"), j.alias("j"), step("pl").alias("g"), step("fp").alias("fg"))
    d = d.select("*", F.least("i", "j").alias("most_l"), F.least(F.size("hw") - F.col("i"), F.size("fh") - F.col("j")).alias("most_r"))
    own = lambda c, k: F.get(c, F.col("i") + k)
    his = lambda c, k: F.get(c, F.col("j") + k)
    left = F.filter(F.sequence(F.lit(0), "most_l"), lambda a: (a > 0) & ((own("hw", -a) != his("fh", -a)) | (own("g", 1 - a) != his("fg", 1 - a))))
    right = F.filter(F.sequence(F.lit(0), F.col("most_r") - 1), lambda a: (a > 0) & ((own("hw", a) != his("fh", a)) | (own("g", a) != his("fg", a))))
    d = d.select("*", F.coalesce(F.get(left, F.lit(0)) - 1, "most_l").alias("l"), F.coalesce(F.get(right, F.lit(0)) - 1, F.col("most_r") - 1).alias("r"))
    both = lambda k: F.least(own("g", k), his("fg", k)) - 1
    d = d.select("id", "x", "u", "hw", "pl", "g", "runs", (F.col("q") - F.col("l")).alias("lo"), (F.col("q") + F.col("r")).alias("hi"),
                 both(-F.col("l")).alias("before"), both(F.col("r") + 1).alias("behind"))

    def reach(y: Column) -> Column:
        inside = (y["r"] >= F.col("lo")) & (y["s"] <= F.col("hi"))
        lead = F.when(y["r"] == F.col("lo"), F.least(y["lead"], F.col("before"))).otherwise(y["lead"])
        trail = F.when(y["s"] == F.col("hi"), F.least(y["trail"], F.col("behind"))).otherwise(y["trail"])
        return F.struct(*(y[c].alias(c) for c in ("r", "s", "lead", "trail")), F.when(inside, lead).otherwise(-1).alias("d"), F.when(inside, trail).otherwise(0).alias("e"))

    d = d.select("id", "x", "u", "hw", "pl", "g", F.transform("runs", reach).alias("y"))
    spot = lambda k: F.get("pl", k - F.col("u") + 1)
    hit = F.filter("y", lambda y: y["d"] >= 0)

    def missed(y: Column) -> Column:
        def window(lead: Column, trail: Column) -> Column:
            n = y["s"] - y["r"]
            return F.struct(F.xxhash64(F.slice("hw", y["r"] - F.col("u") + 1, n + 1), F.slice("g", y["r"] - F.col("u") + 2, n), lead, trail).alias("g"),
                            (spot(y["r"]) - lead).alias("at"), (spot(y["s"]) + trail).alias("to"))

        none = F.array().cast("array<struct<g:bigint,at:int,to:int>>")
        leads = F.when(y["d"] < y["lead"], F.transform(F.sequence(y["d"] + 1, y["lead"]), lambda k: window(k, F.lit(0)))).otherwise(none)
        trails = F.when(y["e"] < y["trail"], F.transform(F.sequence(y["e"] + 1, y["trail"]), lambda k: window(F.lit(0), k))).otherwise(none)
        return F.concat(leads, trails)

    return d.select(
        "id", "x", F.array_min(F.transform(hit, lambda y: spot(y["r"]) - y["d"])).alias("at"), F.array_max(F.transform(hit, lambda y: spot(y["s"]) + y["e"])).alias("to"),
        F.flatten(F.transform(F.filter("y", lambda y: (y["d"] < y["lead"]) | (y["e"] < y["trail"])), missed)).alias("rest"))


def repeated(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, x, gone: places of the lines to remove) for the documents that repeat a run of an earlier place.

    Every place of a fingerprint that has two or more is joined to its first one (least id, x, line), and the match is extended
    both ways; windows in it go. A window outside of it can only stand at other places where the match fails too: those are grouped by
    the hash of the window, and all but the first go. Rows are never paired with each other: a passage in k documents
    makes k rows, minima are combined before the shuffle, and the joins are with unique keys and end in a written table or another
    shuffle, so that adaptive execution may split the part of a frequent passage.
    """
    marks = written(fingerprints(hashed(docs), least_words), "marks")
    where = F.xxhash64("id", "x", "q")
    shared = marks.groupBy("m").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a != b").select("m")
    near = written(marks.join(settle(shared), "m"), "places")
    discard(marks)
    first = near.groupBy("m").agg(F.min(F.struct("id", "x", "q", "u", "hw", "pl")).alias("f"))
    pairs = near.join(settle(first), "m").where(F.struct("id", "x", "q") > F.struct("f.id", "f.x", "f.q"))
    met = written(extended(pairs), "matches")
    discard(near)
    rest = met.select("id", "x", F.inline("rest"))
    place = F.struct("id", "x", "at")
    source = rest.groupBy("g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("g", "first")
    later = rest.join(settle(source), "g").where(place > F.col("first")).select("id", "x", "at", "to")
    gone = met.where("at IS NOT NULL").select("id", "x", "at", "to").unionByName(later)
    gone = gone.groupBy("id", "x").agg(F.collect_set(F.struct("at", "to")).alias("runs"))
    gone = settle(gone.select("id", "x", F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["to"]))))).alias("gone")))
    discard(met)
    return gone


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with later repeats of runs of lines removed from `text`, and n_lines_removed and removed.

    A line ends at a line feed or a sentence end. A run is a sequence of lines, equal but for white space at their ends, that
    stands earlier too (in a document of smaller doc_id, or further up) and has at least `least_words` words. `removed`
    has the places of the removed lines. Every such run is found, whatever the length of its lines and wherever its parts stand
    earlier too; the first occurrence stays.

    Null text stays null, and empty text empty. Null doc_ids come before all others. Rows of equal doc_id and
    text count as one document, and get the same result. An empty table gives no rows. Other columns are carried along, but
    for those that have the name of an added one, which the added one replaces.
    """
    names = {c.lower() for c in docs.columns}
    key, x, gone, parts, rest = (_free(c, names) for c in ("_id", "_x", "_gone", "_parts", "_rest"))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63))).withColumn(x, F.xxhash64("text"))
    found = repeated(keyed.where("text IS NOT NULL").select(F.col(key).alias("id"), F.col(x).alias("x"), "text"), least_words)
    out = keyed.join(found.toDF(key, x, gone), [key, x], "left")
    out = once(out, parts, F.when(F.col(gone).isNotNull(), lines(F.col("text"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    left = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "")
    out = once(out, rest, F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    return out.select(
        *(F.col(rest).alias("text") if c == "text" else docs[c] for c in docs.columns if c.lower() not in ADDED),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(ADDED[0]), F.col(gone).alias(ADDED[1]),
    )


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name
