"""Secret scans: fixed patterns, and character Markov models compared by likelihood ratio.

DataFrame and SQL functions only. Two first-order models over the same alphabet, one of
random strings and one of ordinary identifiers, are counted from labelled samples; a
candidate run is a secret if its log-likelihood ratio is high enough in total and per
character.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import read_table

#: Fixed patterns; in ASSIGN the second group of the description is group 1.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Runs that the models judge.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
KINDS = ("assign", "access", "hex", "markov")

#: About so many documents (dealt by a hash of the id) give labelled samples, and so many
#: random strings are made of digests.
SAMPLE_DOCS = 4_000
SAMPLE_RANDOM = 3_000
LEAST_RATIO = 12.0
LEAST_PER_CHARACTER = 1.2


#: Matches that are put in order together: a text's time grows with its length, not its square.
PIECE = 256
SPAN = "STRUCT<start: INT, ord: INT, end: INT, kind: STRING, value: STRING, bs: INT, be: INT>"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once for all its places in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _pieces(array: str, body: str) -> str:
    """SQL for an array of what ``body`` makes of each run of PIECE elements (``piece``)."""
    return f"transform(sequence(0, (size({array}) - 1) div {PIECE}), k -> {_let('piece', f'slice({array}, k * {PIECE} + 1, {PIECE})', body)})"


def _before(array: str, start: str, body: str) -> str:
    """SQL for the array of what ``body`` (of s and x) has added up before each element x."""
    return f"aggregate({array}, named_struct('s', {start}, 'out', cast(array() AS ARRAY<INT>)), (a, x) -> named_struct('s', {body.replace('$s', 'a.s')}, 'out', concat(a.out, array(a.s))), a -> a.out)"


def _spans(text: str, pattern: str, kind: str, least: int = 0, value_group: int = 0) -> str:
    """SQL for array<SPAN>: leftmost matches that do not overlap, whose group is ``least`` long or
    longer. ``value`` is the whole match, bs and be are its place in bytes. The gaps between
    matches give the places, so each pattern runs over a text thrice where it occurs and once
    where it does not."""
    p, o, none = _quoted(pattern), KINDS.index(kind), f"cast(array() AS ARRAY<{SPAN}>)"
    start = f"named_struct('at', 0, 'by', 0, 'out', {none})"
    one = f"""named_struct('start', s.at + length(x.`2`), 'ord', {o}, 'end', s.at + length(x.`2`) + length(x.`0`), 'kind', '{kind}', 'value', x.`0`,
        'bs', s.by + octet_length(x.`2`), 'be', s.by + octet_length(x.`2`) + octet_length(x.`0`))"""
    step = f"""IF(x.`0` IS NULL, s, named_struct('at', s.at + length(x.`2`) + length(x.`0`), 'by', s.by + octet_length(x.`2`) + octet_length(x.`0`),
        'out', IF(length(x.`1`) >= {least}, concat(s.out, array({one})), s.out)))"""
    moved = "transform(q.p.out, z -> named_struct('start', z.start + q.c, 'ord', z.ord, 'end', z.end + q.c, 'kind', z.kind, 'value', z.value, 'bs', z.bs + q.b, 'be', z.be + q.b))"
    parts = _pieces("z", f"aggregate(piece, {start}, (s, x) -> {step})")
    placed = f"flatten(transform(zip_with(arrays_zip(ps, {_before('ps', '0', '$s + x.at')}), {_before('ps', '0', '$s + x.by')}, (u, v) -> named_struct('p', u.`ps`, 'c', u.`1`, 'b', v)), q -> {moved}))"
    return f"""IF({text} RLIKE {p},
      {_let('z', f"arrays_zip(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {value_group}), split({text}, {p}, -1))", _let('ps', parts, placed))},
      {none})"""


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform(array_sort({spans}), z -> concat(z.kind, ':', z.start, ':', z.end)), ',')")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS, random: int = SAMPLE_RANDOM,
          labelled: DataFrame | None = None) -> list[float]:
    """Log ratios of the transitions, row by row over ALPHABET.

    Labelled samples (``text``, ``secret`` 0/1) are, unless given: what the fixed patterns
    match in about ``sample`` documents and ``random`` digests written in base 64, base 16 and upper case (1),
    and the other words of these documents (0). Counts are summed by Spark; the driver gets at
    most two numbers per transition. Add-one smoothing makes an unseen model uniform.
    """
    spark = docs.sparkSession
    if labelled is None:
        total = docs.select(id_col).count()
        part = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        if total > sample:
            part = part.where(F.pmod(F.xxhash64(F.lit("train"), "i"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
        found = part.select("t", F.expr(f"concat(regexp_extract_all(t, {_quoted(ASSIGN)}, 1), regexp_extract_all(t, {_quoted(ACCESS)}, 0), regexp_extract_all(t, {_quoted(HEX)}, 0))").alias("v"))
        secret = found.select(F.explode("v").alias("text"), F.lit(1).alias("secret")).where(F.length("text") >= 12)
        plain = found.select(F.explode(F.expr("array_except(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{6,}', 0), v)")).alias("text"), F.lit(0).alias("secret"))
        plain = plain.where(~F.col("text").rlike(f"{HEX}|{ACCESS}"))
        made = spark.range(random).select(F.explode(F.array(
            F.expr("regexp_replace(base64(unhex(sha2(concat('a', id), 256))), '[\\\\r\\\\n]', '')"), F.expr("sha2(concat('b', id), 256)"),
            F.expr("upper(regexp_replace(base64(unhex(sha2(concat('c', id), 256))), '[^A-Za-z0-9]', ''))"))).alias("text"), F.lit(1).alias("secret"))
        labelled = secret.unionByName(plain).unionByName(made)
    pairs = labelled.where(F.col("secret").isin(0, 1) & (F.length("text") >= 2)).select(
        F.col("secret").cast("int").alias("secret"), F.explode(F.expr(_let("v", "cast(text AS BINARY)", "transform(sequence(1, length(v) - 1), i -> cast(substring(v, i, 2) AS STRING))"))).alias("p"))
    counts = {(r["secret"], r["p"]): r["n"] for r in pairs.where(F.col("p").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("secret", "p").agg(F.count("*").alias("n")).collect()}
    out = []
    for a in ALPHABET:
        rows = [[counts.get((k, a + b), 0) + 1 for b in ALPHABET] for k in (0, 1)]
        sums = [sum(r) for r in rows]
        out += [math.log(y / sums[1]) - math.log(x / sums[0]) for x, y in zip(*rows)]
    return [round(x, 6) for x in out]


def log_ratio(run: str, ratios: list[float]) -> str:
    """SQL for the log-likelihood ratio of a run, transition by transition. Runs are ASCII, so
    that a character is a byte, which is found without reading the run up to it."""
    table = "cast(split('" + ",".join(f"{x:.6g}" for x in ratios) + "', ',') AS ARRAY<DOUBLE>)"
    codes = "cast(split('" + ",".join(str(max(0, ALPHABET.find(chr(k)))) for k in range(1, 128)) + "', ',') AS ARRAY<INT>)"
    place = lambda i: f"element_at({codes}, ascii(cast(substring(v, {i}, 1) AS STRING)))"
    return _let("v", f"cast({run} AS BINARY)", f"aggregate(sequence(1, length(v) - 1), 0D, (acc, i) -> acc + element_at({table}, {place('i')} * {len(ALPHABET)} + {place('i + 1')} + 1))")


def _free(runs: str, base: str) -> str:
    """SQL for the runs that no span of ``base`` holds. A span of capitals or hex holds a run only
    if it is the run; the runs inside an assignment are looked up in its text. Runs and what
    covers them are sorted together: a run is covered if the next entry has its place."""
    key = lambda start, end: f"shiftleft(cast({start} AS BIGINT), 32) + {end}"
    inner = f"flatten(transform(filter({base}, b -> b.kind = 'assign'), b -> transform({_spans('b.value', RUN, 'markov')}, r -> {key('b.start + r.start', 'b.start + r.end')})))"
    covers = f"concat(transform(filter({base}, b -> b.kind <> 'assign'), b -> {key('b.start', 'b.end')}), {inner})"
    both = f"array_sort(concat(transform({runs}, r -> named_struct('key', {key('r.start', 'r.end')}, 'tag', 0, 'r', r)), transform({covers}, c -> named_struct('key', c, 'tag', 1, 'r', cast(NULL AS {SPAN})))))"
    following = "concat(transform(slice(y, 2, size(y)), f -> f.key), array(-1L))"
    return f"""IF(size({runs}) = 0 OR size({base}) = 0, {runs},
        {_let('y', both, f"transform(filter(zip_with(y, {following}, (u, f) -> named_struct('u', u, 'f', f)), x -> x.u.tag = 0 AND x.f <> x.u.key), x -> x.u.r)")})"""


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text", least: float = LEAST_RATIO, per_character: float = LEAST_PER_CHARACTER) -> DataFrame:
    """``docs`` with _base and _all: sorted arrays of spans in code points, end exclusive.

    A null or empty text has none. A run inside a span of the fixed patterns is left to it;
    one that reaches beyond is judged as a whole, so spans may overlap. Spans that start
    together stand in the order of KINDS. Rows are judged alone, without a shuffle, equal rows
    alike; the time for a text grows with its length (times the logarithm of its number of spans).
    """
    out = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("_base", F.expr(f"""array_sort(concat({_spans('_t', ASSIGN, 'assign', 12, 1)},
        {_spans('_t', ACCESS, 'access')}, {_spans('_t', HEX, 'hex')}))"""))
    out = out.withColumn("_runs", F.expr(_spans("_t", RUN, "markov"))).withColumn("_free", F.expr(_free("_runs", "_base")))
    out = out.withColumn("_more", F.expr(f"filter(_free, r -> {log_ratio('r.value', ratios)} >= greatest({least}D, {per_character}D * length(r.value)))"))
    return out.withColumn("_all", F.expr("array_sort(concat(_base, _more))")).drop("_t", "_runs", "_free", "_more")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """id, counts of the fixed kinds, digest of their spans and all spans of each whole text."""
    ratios = ratios or train(docs, id_col, text_col)
    found = scan(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), ratios, "_text")
    count = lambda k: F.expr(f"cast(size(filter(_base, z -> z.kind = '{k}')) AS BIGINT)")
    return found.select(
        F.col("_id").alias(id_col), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_all").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", ratios: list[float] | None = None, length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping ones by one; texts without spans stay as they are, null ones too.
    ``length_col`` names a column that holds the texts' length and follows them."""
    ratios = ratios or train(docs, id_col, text_col)
    # the row is packed, so that no column's name can clash
    found = scan(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("_text")), ratios, "_text")
    found = found.withColumn("_bytes", F.expr("cast(_text AS BINARY)"))
    ends = _before(_pieces("_all", "array_max(transform(piece, z -> z.be))"), "0", "greatest($s, x)")
    step = f"""IF(z.bs >= s.at, named_struct('at', z.be, 'out', concat(s.out, array(cast(substring(_bytes, s.at + 1, z.bs - s.at) AS STRING), '{mark}'))),
        named_struct('at', greatest(s.at, z.be), 'out', s.out))"""
    cleaned = f"aggregate(e.piece, named_struct('at', e.at, 'out', cast(array() AS ARRAY<STRING>)), (s, z) -> {step}, s -> s.out)"
    clean = F.expr(f"""concat(array_join(flatten(transform(zip_with({_pieces('_all', 'piece')}, {ends}, (p, a) -> named_struct('piece', p, 'at', a)), e -> {cleaned})), ''),
        cast(substring(_bytes, array_max(transform(_all, z -> z.be)) + 1, octet_length(_text)) AS STRING))""")
    out = found.withColumn("_new", F.when(F.size("_all") > 0, clean).otherwise(F.col("_text")))
    changed = {text_col: F.col("_new")}
    if length_col:
        changed[length_col] = F.when(F.size("_all") > 0, F.length("_new").cast("long")).otherwise(F.col("_row")[length_col])
    return out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
