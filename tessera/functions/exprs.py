"""Row-local expressions over paths, kinds, states, spans and costs. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocab as V

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x) -> Column:
    """Lower case for A-Z only; ``lower`` would fold other alphabets too."""
    return F.translate(_c(x), UPPER, LOWER)


def normalize_path(x) -> Column:
    """Relative path with single slashes and without ``.``; NULL for an empty path, one with
    ``..`` or one with a NUL."""
    parts = F.filter(F.split(F.regexp_replace(_c(x), r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    bad = F.contains(_c(x), F.lit("\0")) | F.exists(parts, lambda p: p == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def file_name(x) -> Column:
    return F.element_at(F.split(_c(x), "/"), -1)


def parent(x) -> Column:
    """Path of the directory; NULL at the root."""
    return F.when(F.contains(_c(x), F.lit("/")), F.regexp_extract(_c(x), "^(.*)/[^/]*$", 1))


def extension(x) -> Column:
    """ASCII-lower-cased extension; NULL without a stem or without an extension."""
    ext = F.regexp_extract(file_name(x), r"^.+\.([^.]+)$", 1)
    return F.when(ext != "", ascii_lower(ext))


def without_extension(x) -> Column:
    return F.when(extension(x).isNull(), _c(x)).otherwise(F.regexp_replace(_c(x), r"\.[^./]+$", ""))


def depth(x) -> Column:
    return F.size(F.split(_c(x), "/"))


def is_within(path, base) -> Column:
    """By components, not by prefix."""
    return (_c(path) == _c(base)) | F.startswith(_c(path), F.concat(_c(base), F.lit("/")))


def within_range(path, base: str) -> Column:
    """The same for a literal base as a range, which prunes sorted Parquet: ``0`` follows ``/``."""
    return (_c(path) == base) | ((_c(path) >= base + "/") & (_c(path) < base + "0"))


def eq_ignore_case(a, b) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def language_of(x) -> Column:
    """Language by extension; the first language in order claims an extension."""
    table: dict[str, str] = {}
    for lang, exts in V.LANGUAGES.items():
        for e in exts:
            table.setdefault(e, lang)
    out, ext = F.lit(None).cast("string"), extension(x)
    by_lang: dict[str, list[str]] = {}
    for e, lang in table.items():
        by_lang.setdefault(lang, []).append(e)
    for lang, exts in by_lang.items():
        out = F.when(ext.isin(*exts), lang).otherwise(out)
    return out


def parse_language(name: str) -> str | None:
    low = name.strip().lower()
    return low if low in V.LANGUAGES else V.ALIASES.get(low)


def has_component(path, names) -> Column:
    """Any component but the file name, lower-cased, among ``names``."""
    dirs = F.transform(F.slice(F.split(_c(path), "/"), F.lit(1), F.size(F.split(_c(path), "/")) - 1), lambda p: ascii_lower(p))
    return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))


def excluded(path, names=V.VCS_NAMES + V.NOISE_NAMES) -> Column:
    """Any component, lower-cased, in the set of names left out."""
    return F.arrays_overlap(F.transform(F.split(_c(path), "/"), lambda p: ascii_lower(p)), F.array(*[F.lit(n.lower()) for n in names]))


def _contains_any(x: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(x, F.lit(m))
    return out


def is_test_name(path) -> Column:
    name, low = file_name(path), ascii_lower(file_name(path))
    return low.isin(*V.TEST_NAMES) | F.startswith(name, F.lit("test_")) | F.startswith(name, F.lit("test-")) | _contains_any(low, V.TEST_SUFFIXES)


def classify(path, text) -> Column:
    """vendored, generated, test or source: the first rule that holds. The header is so many
    bytes, not characters."""
    head = ascii_lower(F.substring(F.encode(_c(text), "UTF-8"), 1, V.HEADER_BYTES).cast("string"))
    return (
        F.when(has_component(path, V.VENDORED_DIRS), "vendored")
        .when(has_component(path, V.GENERATED_DIRS), "generated")
        .when(_contains_any(head, V.GENERATED_MARKERS), "generated")
        .when(_contains_any(ascii_lower(file_name(path)), V.GENERATED_NAMES), "generated")
        .when(has_component(path, V.TEST_DIRS), "test")
        .when(is_test_name(path), "test")
        .otherwise("source")
    )


def kind_ord(kind) -> Column:
    return (F.array_position(F.array(*[F.lit(k) for k in V.ENTITY_KINDS]), _c(kind)) - 1).cast("int")


def is_type(kind) -> Column:
    return _c(kind).isin(*V.TYPE_KINDS)


def is_callable(kind) -> Column:
    return _c(kind).isin(*V.CALLABLE_KINDS)


def is_member(kind) -> Column:
    return _c(kind).isin(*V.MEMBER_KINDS)


def is_container(kind) -> Column:
    return _c(kind).isin(*V.CONTAINER_KINDS)


def is_structural(kind) -> Column:
    return _c(kind).isin(*V.STRUCTURAL)


def is_declaration(kind) -> Column:
    return _c(kind) != "file"


def is_binding(kind) -> Column:
    return _c(kind).isin(*V.BINDING_KINDS)


def is_namespace(kind) -> Column:
    return _c(kind).isin(*V.NAMESPACE_KINDS)


def last_name(qualified) -> Column:
    return F.substring_index(_c(qualified), ".", -1)


def parent_name(qualified) -> Column:
    return F.when(F.contains(_c(qualified), F.lit(".")), F.regexp_extract(_c(qualified), r"^(.*)\.[^.]*$", 1))


def is_followable(state="resolution_state", target="target_path") -> Column:
    return _c(state).isin("resolved", "inferred") & _c(target).isNotNull()


def walk_followable(kind="kind", state="resolution_state", target="target_path", follow_inferred: bool = True) -> Column:
    out = ~is_structural(kind) & is_followable(state, target)
    return out if follow_inferred else out & (_c(state) != "inferred")


def chainable(state="resolution_state", target="target_path", follow_inferred: bool = True) -> Column:
    out = is_followable(state, target)
    return out if follow_inferred else out & (_c(state) != "inferred")


def strength(ev_class) -> Column:
    out = F.lit(0)
    for name, n in V.STRENGTH.items():
        out = F.when(_c(ev_class) == name, n).otherwise(out)
    return out


def uncertainty(state) -> Column:
    out = F.lit(9)
    for name, n in V.UNCERTAINTY.items():
        out = F.when(_c(state) == name, n).otherwise(out)
    return out


def describe_state(state="resolution_state", ev_class="ev_class", basis="basis", reason="reason", candidates=None) -> Column:
    n = F.coalesce(F.size(candidates), F.lit(0)) if candidates is not None else F.lit(0)
    return (
        F.when(_c(state) == "resolved", F.concat(F.lit("resolved ("), _c(ev_class), F.lit(")")))
        .when(_c(state).isin("inferred", "pending"), F.concat(_c(state), F.lit(" ("), _c(ev_class), F.lit("): "), F.coalesce(_c(basis), F.lit(""))))
        .when(_c(state) == "ambiguous", F.concat(F.lit("ambiguous ("), n.cast("string"), F.lit(" candidates)")))
        .otherwise(F.concat(F.lit("unresolved ("), F.coalesce(_c(reason), F.lit("no_candidate")), F.lit(")")))
    )


def entity_display(path, qualified, ordinal) -> Column:
    return F.concat(_c(path), F.lit("::"), _c(qualified), F.when(_c(ordinal) > 0, F.concat(F.lit("#"), _c(ordinal).cast("string"))).otherwise(F.lit("")))


#: What stands between the parts of an id.
ID_MARK = "\x1f"


def entity_id(path="path", kind="kind", qualified="qualified_name", ordinal="entity_ordinal") -> Column:
    """One string per identity, in the order (path, kind by rank, qualified name, ordinal)."""
    sep = F.lit(ID_MARK)
    return F.when(_c(path).isNotNull(), F.concat(_c(path), sep, F.lpad(kind_ord(kind).cast("string"), 2, "0"), sep, _c(qualified), sep, F.lpad(_c(ordinal).cast("string"), 6, "0")))


def token_cost(text, per: int = V.BYTES_PER_TOKEN) -> Column:
    """UTF-8 bytes by ``per``, rounded up; 0 counts bytes themselves."""
    size = F.octet_length(_c(text)).cast("long")
    return size if per == 0 else F.floor((size + (per - 1)) / per).cast("long")


def span_contains(a0, a1, b0, b1) -> Column:
    return (_c(a0) <= _c(b0)) & (_c(b1) <= _c(a1))


def span_overlaps(a0, a1, b0, b1) -> Column:
    return (_c(a0) < _c(b1)) & (_c(b0) < _c(a1))


def span_union(a0, a1, b0, b1) -> tuple[Column, Column]:
    return F.least(_c(a0), _c(b0)), F.greatest(_c(a1), _c(b1))


def byte_slice(text, start, end) -> Column:
    return F.expr(f"decode(substring(encode({text}, 'UTF-8'), {start} + 1, {end} - {start}), 'UTF-8')")


def unresolved_reason(target) -> Column:
    """external for a spelling that names a place elsewhere, else no_candidate."""
    inner = F.regexp_replace(_c(target), r"^\.+|\.+$", "")
    return F.when(F.contains(_c(target), F.lit("::")) | F.contains(_c(target), F.lit("/")) | (F.contains(_c(target), F.lit(".")) & F.contains(inner, F.lit("."))), "external").otherwise("no_candidate")


def crate_relative(module, package=None) -> Column:
    first = F.split(_c(module), "::")[0]
    out = first.isin("", "crate", "self")
    return out if package is None else out | F.coalesce(first == _c(package), F.lit(False))


def percent_floor(part, whole) -> Column:
    return F.when(_c(whole) == 0, F.lit(0).cast("long")).otherwise(F.floor(_c(part) * 100 / _c(whole)).cast("long"))


def hundredths(n, d) -> Column:
    """n/d in hundredths of a percent, half up, in exact integers."""
    n, d = _c(n).cast("decimal(30,0)"), _c(d).cast("decimal(30,0)")
    return F.when(d == 0, F.lit(None).cast("long")).otherwise(((n * 20000 + d - F.pmod(n * 20000 + d, d * 2)) / (d * 2)).cast("long"))


def meets_floor(n, d, floor) -> Column:
    return _c(n).cast("decimal(30,0)") * 10000 >= _c(floor).cast("decimal(30,0)") * _c(d).cast("decimal(30,0)")


def fingerprint(x) -> Column:
    """``fnv1a64`` of a column, in Arrow batches; for short texts such as names."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    of = pandas_udf(lambda values: values.map(lambda v: None if v is None else fnv1a64(v)), "string", PandasUDFType.SCALAR)
    return of(_c(x))


def fnv1a64(text: str) -> str:
    """Fingerprint on the driver or in a Python stage: ``fnv1a64:`` and 16 hex digits."""
    h = 0xCBF29CE484222325
    for b in text.encode("utf-8"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"fnv1a64:{h:016x}"
