"""Removal of repeated multi-line passages, by DataFrame functions only.

A text is its lines (split at \\n). Each line has a hash; a rolling hash over the hashes of the last
``window`` lines decides whether a chunk ends after a line (it does where the rolling hash is 0 modulo
``divisor``, and at the end of the text), so boundaries follow the content and a passage is cut alike
wherever it stands. Chunks of one line, or without any word, are never touched. The hashes of the other
chunks are counted over the whole corpus; only chunks whose hash repeats are compared by their bytes, and
every occurrence of a repeated chunk but the first (by id, then place) goes.

Null ids come last; rows that agree in id and text are one document and are treated alike. A null text
stays null; an empty text stays empty; a text that loses all its chunks becomes empty. All other columns
stay as they are, whatever their names. Results don't depend on how rows are dealt to partitions.

remove_passages() is the whole job, and what the pipeline runs. A text is cut before the white space that ends a
line or follows one of .!? (so long lines are sentences). A passage is a run of such pieces; every passage of 50 words or
more that also stands earlier, in an earlier document or further up and clear of itself, goes, whatever stands around it.
Boundaries are chosen by content here too: in each shortest run of enough words, the place of the least rolling hash over two
neighbouring pieces' hashes is a boundary, so two copies of a passage hold a boundary at the same place, however they are surrounded.
Boundaries whose rolling hash repeats are the seeds: runs around them, grown piece by piece to enough words, are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import field, saved

WINDOW, DIVISOR = 2, 3
MULTIPLIER, MODULUS = 1_000_003, 2_147_483_647
#: Words of the shortest passage that goes; where a text is cut into pieces.
PASSAGE_WORDS = 50
#: Bytes of a run's SHA-256 by which it is known.
DIGEST_BYTES = 16
SPACE = " \t\n\v\f\r"
PIECE_ENDS = r"(?=\s)(?:(?<=[.!?])|(?<=\S)(?=\s*\n))"


def _line_hashes(text: Column) -> Column:
    """28 bits of each line's MD5."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("bigint"))


def _chunked(rows: DataFrame, window: int, divisor: int) -> DataFrame:
    """rows (with a column text) and chunks, an array of (at: its number, lines: how many, text)."""
    lines = rows.withColumns({"lines": F.split("text", "\n", -1), "hashes": _line_hashes(F.col("text"))})

    def rolled(i: Column) -> Column:
        value = F.lit(0).cast("bigint")
        for back in range(window - 1, -1, -1):
            one = F.when(i >= back, F.get("hashes", i - back)).otherwise(F.lit(0).cast("bigint"))
            value = (value * MULTIPLIER + one) % MODULUS
        return value

    last = F.size("lines") - 1
    ends = lines.withColumn("ends", F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (rolled(i) % divisor == 0)))

    def chunk(end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("ends", k - 1) + 1)
        return F.struct(k.alias("at"), (end - start + 1).alias("lines"), F.array_join(F.slice("lines", start + 1, end - start + 1), "\n").alias("text"))

    return ends.withColumn("chunks", F.transform("ends", chunk)).drop("lines", "hashes", "ends")


def _document(text: Column) -> Column:
    """A document: its id and a hash of its text."""
    return F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.xxhash64(text).alias("hash"))


def _several(chunks: str = "chunks") -> Column:
    """The chunks of several lines with a word."""
    return F.filter(chunks, lambda c: (c.lines > 1) & c.text.rlike(r"\S"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """For every row: row (a struct of all columns of docs), text (what stays of it), n_lines, n_removed (lines), n_chunks_removed."""
    rows = docs.select(F.struct(*[field(c) for c in docs.columns]).alias("row"), field(doc_id).alias("doc_id"), field(text).alias("text"))
    rows = rows.select("row", "text", _document(F.col("text")).alias("doc"))

    # The place and hash of every chunk, without its text; the hashes that repeat; the documents that hold them.
    chunks = _chunked(rows.where("text is not null").select("doc", "text"), window, divisor)
    spots = chunks.select("doc", F.explode_outer(F.transform(_several(), lambda c: F.struct(c["at"].alias("at"), F.xxhash64(c.text).alias("hash")))).alias("spot"))  # explode() would infer a filter that computes all chunks anew
    spots = saved(spots.where("spot is not null").select("doc", "spot.at", "spot.hash"))
    # Both sides of a join by hash are written tables: so Spark can split the hash of a very common chunk.
    repeated = saved(spots.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    wanted = spots.join(repeated, "hash").groupBy("doc").agg(F.collect_list(F.struct("at", "hash")).alias("wanted"))
    joined = saved(rows.drop("text").join(wanted, "doc", "left"))
    body = F.col("row").getField(text)
    held = joined.where("wanted is not null").withColumn("text", body)

    # The texts of these chunks; each task first brings a text's occurrences down to one: grouping by the text compares the bytes.
    own = _chunked(held.select("doc", "wanted", "text"), window, divisor)
    own = own.select("doc", F.explode_outer(F.transform("wanted", lambda w: F.when(w["at"] < F.size("chunks"), F.get("chunks", w["at"])))).alias("chunk"))  # named twice: a column that is named once would be computed anew for every element
    own = own.select(F.struct("doc", "chunk.at").alias("spot"), F.xxhash64("chunk.text").alias("hash"), F.col("chunk.text").alias("chunk"))
    firsts = saved(own.groupBy("hash", "chunk").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n")))
    by_hash = firsts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.max("n").alias("n"))
    by_hash = saved(by_hash)
    places = joined.where("wanted is not null").select("doc", F.inline("wanted")).select(F.struct("doc", "at").alias("spot"), "hash")
    gone = places.join(by_hash.where("texts = 1 and n > 1").select("hash", "first"), "hash").where("spot <> first").select("spot")
    # Different texts of one hash: occurrences are told apart by the text itself.
    clashing = firsts.join(by_hash.where("texts > 1").select("hash"), "hash", "left_semi").where("n > 1")
    if not clashing.isEmpty():
        gone = gone.union(own.join(clashing, ["hash", "chunk"]).where("spot <> first").select("spot"))
    gone = gone.groupBy(F.col("spot.doc").alias("doc")).agg(F.collect_set("spot.at").alias("gone"))

    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    whole = joined.where("wanted is null").withColumn("text", body).select("row", "text", n_lines.alias("n_lines"), F.lit(0).alias("n_removed"), F.lit(0).alias("n_chunks_removed"))
    cut = _chunked(held.drop("wanted").join(gone, "doc", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))), window, divisor)
    stays = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), "gone")
    cut = cut.withColumn("left", F.transform(stays, lambda k: F.when(k < F.size("chunks"), F.get("chunks", k))))
    lines_left = F.aggregate("left", F.lit(0), lambda n, c: n + c.lines)
    cut = cut.select("row", F.array_join(F.transform("left", lambda c: c.text), "\n").alias("text"), n_lines.alias("n_lines"), (n_lines - lines_left).alias("n_removed"), F.size("gone").alias("n_chunks_removed"))
    return whole.unionByName(cut)


def report(removed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return removed.select(
        F.col("row").getField(doc_id).alias("doc_id"), F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"),
        F.col("n_chunks_removed").cast("bigint").alias("n_chunks_removed"), F.sha2("text", 256).alias("text_sha256"), "text",
    )


def _words_of(trimmed: Column) -> Column:
    """Words of a text without white space around it. Most have single spaces only, and these are counted without a pattern."""
    odd = F.lit(False)
    for sign in ("  ", *SPACE[1:]):
        odd |= trimmed.contains(sign)
    spaces = F.octet_length(trimmed) - F.octet_length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(trimmed == "", 0).when(odd, F.regexp_count(trimmed, F.lit(r"\S+"))).otherwise(spaces + 1)


def _pieces(rows: DataFrame, words: int) -> DataFrame:
    """rows (with a column text) and: pieces (of which only the last can be without words), and ends: the piece with which the shortest run of enough words that starts with each piece ends, null if none does."""
    out = rows.withColumn("pieces", F.split("text", PIECE_ENDS, -1))
    out = out.withColumn("trimmed", F.transform("pieces", lambda p: F.trim(p, F.lit(SPACE))))
    out = out.withColumn("of", F.flatten(F.transform("trimmed", lambda p, i: F.array_repeat(i, _words_of(p)))))  # the piece of each word
    out = out.withColumn("at", F.filter(F.transform("of", lambda p, i: F.when((i == 0) | (F.get("of", i - 1) != p), i)), lambda i: i.isNotNull()))  # the first word of each piece
    return out.withColumn("ends", F.transform("at", lambda a: F.get("of", a + (words - 1)))).drop("of", "at", "trimmed")


def _with_boundaries(rows: DataFrame) -> DataFrame:
    """rows of _pieces() and boundaries: for each piece that of the shortest run that starts there (hash, at: the piece before it), null if none does. A run of one piece is its own boundary."""
    out = rows.withColumn("hashes", F.transform("pieces", lambda p: F.xxhash64(F.ltrim(p, F.lit(SPACE)))))
    own = F.transform("hashes", lambda h, i: F.struct(h.alias("own"), i.alias("at")))
    out = out.withColumn("pairs", F.zip_with(own, F.slice("hashes", 2, F.size("hashes")), lambda r, after: F.struct(F.xxhash64(r["own"], after).alias("hash"), r["at"].alias("at"))))
    # hashes and pairs are named twice each: a column that is named once would be computed anew for every element
    single = lambda i: F.struct(F.get("hashes", F.least(i, F.size("hashes"))).alias("hash"), i.alias("at"))
    least = lambda i, end: F.array_min(F.slice("pairs", i + 1, F.least(end - i, F.size("pairs"))))
    return out.withColumn("boundaries", F.transform("ends", lambda end, i: F.when(end == i, single(i)).when(end > i, least(i, end)))).drop("hashes", "pairs")


def _run(start: Column, end: Column) -> Column:
    """The pieces of a run, the first without the white space before it."""
    return F.concat(F.array(F.ltrim(F.get("pieces", start), F.lit(SPACE))), F.slice("pieces", start + 2, end - start))


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """For every row: row (a struct of all columns of docs), text (what stays of it), n_pieces, n_removed (pieces).

    Any repeated run of enough words is covered by shortest ones: of each piece either the one that ends with it or the one that starts the run.
    So the boundaries of all shortest runs are counted over the corpus; only around those that repeat are both kinds of runs compared, by 128 bits of their SHA-256.
    """
    rows = docs.select(F.struct(*[field(c) for c in docs.columns]).alias("row"), field(doc_id).alias("doc_id"), field(text).alias("text"))
    rows = rows.select("row", "text", _document(F.col("text")).alias("doc"))

    cut = _with_boundaries(_pieces(rows.where("text is not null").select("doc", "text"), words))
    # Boundaries come in the order of runs: those of neighbouring runs that share one are one spot, with its first and last run.
    new = F.transform("boundaries", lambda b, i: F.when(b.isNotNull() & ~F.coalesce(F.get("boundaries", i - 1)["at"] == b["at"], F.lit(False)), i))
    cut = cut.withColumn("firsts", F.filter(new, lambda i: i.isNotNull()))
    last = lambda k: F.coalesce(F.get("firsts", k + 1), F.size("boundaries")) - 1
    spots = cut.select("doc", F.explode_outer(F.transform("firsts", lambda s, k: F.struct(F.get("boundaries", s)["hash"].alias("hash"), s.alias("first"), last(k).alias("last")))).alias("spot"))  # explode() would infer a filter that computes all boundaries anew
    spots = saved(spots.where("spot is not null").select("doc", "spot.first", "spot.last", "spot.hash"))
    repeated = saved(spots.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    wanted = spots.join(repeated, "hash").groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("wanted"))
    joined = saved(rows.drop("text").join(wanted, "doc", "left"))
    body = F.col("row").getField(text)
    held = joined.where("wanted is not null").withColumn("text", body)

    def told(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.substring(F.unhex(F.sha2(F.array_join(_run(start, end), ""), 256)), 1, DIGEST_BYTES).alias("digest"))

    own = _pieces(held.select("doc", "wanted", "text"), words)
    starts = F.filter(F.flatten(F.transform("wanted", lambda r: F.sequence(r["first"], r["last"]))), lambda s: F.get("ends", s).isNotNull())
    own = own.withColumn("wanted", starts)  # starts of the shortest runs around a repeated boundary
    forward = F.transform("wanted", lambda s: told(s, F.get("ends", s)))
    # The shortest run that ends with a piece starts with s if the run from s ends before, and that from s + 1 behind the piece.
    after, before = (lambda s: F.get("ends", s) + 1), (lambda s: F.coalesce(F.get("ends", s + 1), F.size("ends")) - 1)
    ending = lambda s: F.when(after(s) <= before(s), F.transform(F.sequence(after(s), before(s)), lambda e: told(s, e)))
    backward = F.flatten(F.filter(F.transform("wanted", ending), lambda x: x.isNotNull()))
    own = own.select("doc", F.explode_outer(F.concat(forward, backward)).alias("run"))
    own = saved(own.where("run is not null").select("doc", "run.start", "run.end", "run.digest"))
    firsts = own.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    firsts = saved(firsts)
    again = own.join(firsts, "digest").where(F.struct("doc", "start") != F.col("first"))
    clear = F.col("first.start") + F.col("end") - F.col("start") + 1  # in one document, pieces of both occurrences stay
    again = again.select("doc", F.when(F.col("doc") == F.col("first.doc"), F.greatest("start", clear)).otherwise(F.col("start")).alias("start"), "end").where("start <= end")
    gone = again.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("gone"))

    pieces = F.split("text", PIECE_ENDS, -1)
    whole = joined.where("wanted is null").withColumn("text", body)
    whole = whole.select("row", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)).alias("n_pieces"), F.lit(0).alias("n_removed"))
    left = held.drop("wanted").join(gone, "doc", "left").withColumn("pieces", pieces)
    out = F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["end"]))))
    left = left.withColumn("out", F.coalesce(out, F.array().cast("array<int>")))
    left = left.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), "out"))
    stays = F.array_join(F.transform("kept", lambda i: F.get("pieces", i)), "")
    stays = F.when(F.get("kept", F.lit(0)) > 0, F.ltrim(stays, F.lit(SPACE))).otherwise(stays)
    return whole.unionByName(left.select("row", stays.alias("text"), F.size("pieces").alias("n_pieces"), F.size("out").alias("n_removed")))


def passages_report(removed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return removed.select(
        F.col("row").getField(doc_id).alias("doc_id"), F.col("n_pieces").cast("bigint").alias("n_pieces"), F.col("n_removed").cast("bigint").alias("n_removed"),
        F.sha2("text", 256).alias("text_sha256"), "text",
    )
