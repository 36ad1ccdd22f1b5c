"""Private data: detected entities get keyed surrogates of their own type. DataFrame functions only.

Mentions are found by patterns and cut into parts (the names of a mailbox and of its host, the words of a person's name), so that
a part has the same surrogate wherever it occurs. A surrogate is drawn from a keyed hash: digits become digits, letters letters of their script and case,
an octet stays an octet, a card keeps its check digit right, a given name becomes one of the same gender and script.
The parts of all documents are then checked: no two may have one surrogate, and none may be a part that occurs itself; who loses draws again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import stored, whole_row

_EDGE = r"[\p{L}\p{N}._%+-]"
_TITLES = {"m": ["Mr", "Herr", "Sr", "Señor", "Monsieur", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Madame", "Mme", "Госпожа"]}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in the order in which they are tried, each a Java pattern. Secrets have no longest length; their runs are possessive.
PATTERNS = {
    "mail": rf"(?<!{_EDGE}){_EDGE}{{1,64}}+@[\p{{L}}\p{{N}}-]{{1,63}}(?:\.[\p{{L}}\p{{N}}-]{{1,63}}){{0,8}}\.\p{{L}}{{2,24}}",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+|eyJ[\w-]{10,}+\.[\w-]{10,}+\.[\w-]{10,}+)(?![A-Za-z0-9])"
              # the first look-behind is cheap and fails nearly everywhere
              r"|(?<=[=:\"']|[=:]\s|[=:]\s\s)(?<=(?i:token|secret|password|passwd|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_=-]{8,}+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\d-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?\d{3}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)|(?<![\w.+-])\+\d{1,3}(?:[ .-]\d{2,4}){3,5}(?!\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": r"(?<!\p{L})(?:" + "|".join(t for ts in _TITLES.values() for t in ts) + r")\.? \p{Lu}[\p{L}'-]{1,40}(?: \p{Lu}[\p{L}'-]{1,40}){0,2}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No entity is without one of these; titles are told by their first letters before they are spelled out.
HINT = r"[@0-9=:]|[" + "".join(sorted({t[0] for ts in _TITLES.values() for t in ts})) + r"](?<!\p{L}.)(?:" + "|".join(
    sorted({t[1:] for ts in _TITLES.values() for t in ts})) + r")\.? \p{Lu}"

#: Common given names.
GIVEN = {
    "latin m": ["James", "Robert", "John", "Michael", "David", "Thomas", "Daniel", "Paul", "Peter", "Martin", "Lucas", "Hugo", "Carlos", "Luis", "Jonas", "Felix"],
    "latin f": ["Mary", "Anna", "Laura", "Julia", "Emma", "Sarah", "Clara", "Marie", "Helen", "Sophie", "Lucia", "Elena", "Nora", "Alice", "Ines", "Paula"],
    "cyrillic m": ["Иван", "Пётр", "Алексей", "Николай", "Сергей", "Андрей", "Михаил", "Павел"],
    "cyrillic f": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Вера", "Софья"],
}
_ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ",
              "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_SYLLABLES = {"latin": ["ba", "den", "fo", "gar", "hel", "ki", "lo", "man", "ner", "pa", "rin", "so", "ter", "vi", "wal", "zen"],
              "cyrillic": ["ба", "ден", "фо", "гар", "ки", "ло", "ман", "нер", "па", "рин", "со", "тер", "ви", "вал", "зен", "мир"]}
_CYRILLIC = r"\p{IsCyrillic}"
#: Draws in the shape of the original before a part may grow.
SAME_SHAPE = 6


def mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))


def _kind(mention: Column) -> Column:
    out = F.lit("secret")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _part(kind: Column | str, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def parts(mention: Column) -> Column:
    """A mention as an array of (kind, value); kind '' stays as it is."""
    kind = _kind(mention)
    at = F.split(mention, "@", 2)
    host = F.regexp_extract(at[1], r"^(.*)\.([^.]*)$", 1)
    mail = F.array(_part("box", at[0]), _part("", F.lit("@")), _part("host", host), _part("", F.concat(F.lit("."), F.regexp_extract(at[1], r"([^.]*)$", 1))))
    female = mention.rlike("^(?:" + "|".join(_TITLES["f"]) + r")\b")
    words = F.split(mention, " ")
    named = F.transform(words, lambda w, i: F.when(i == 0, _part("", w)).otherwise(_part(
        F.when((i == 1) & (F.size(words) > 2), F.when(female, "given f").otherwise("given m")).otherwise("surname"), w)))
    spaced = F.flatten(F.transform(named, lambda p, i: F.when(i == 0, F.array(p)).otherwise(F.array(_part("", F.lit(" ")), p))))
    return F.when(kind == "mail", mail).when(kind == "name", spaced).otherwise(F.array(_part(kind, mention)))


def _folded(kind: Column, value: Column) -> Column:
    """What counts as the same entity: case does not matter for mailboxes, hosts and names, nor separators for numbers."""
    return F.when(kind.isin("box", "host", "given f", "given m", "surname"), F.lower(value)).when(kind.isin("card", "iban", "phone", "ssn"), F.regexp_replace(value, r"[^\p{L}\p{N}]", "")).otherwise(value)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _draw(key: str, *of: Column) -> Column:
    """A keyed whole number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[c.cast("string") for c in of]), 256), 1, 12), 16, 10).cast("long")


def _generic(key: str, kind: Column, value: Column, attempt: Column, keep: Column) -> Column:
    """Characters from `keep` on become others of their class."""
    is_hex = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & (kind == "secret")

    def char(c: Column, i: Column) -> Column:
        n = _draw(key, kind, value, attempt, i)
        out = c
        for letters in _ALPHABETS:
            size = F.when(is_hex, 6).otherwise(len(letters)) if letters[0] in "aA" else F.lit(len(letters))
            out = F.when(F.instr(F.lit(letters), c) > 0, F.substr(F.lit(letters), (F.pmod(n, size) + 1).cast("int"), F.lit(1))).otherwise(out)
        out = F.when(c.rlike(r"^\d$"), F.pmod(n, F.lit(10)).cast("string")).otherwise(out)
        out = F.when((out == c) & c.rlike(r"^\p{Ll}$") & ~c.rlike("^[a-zа-яα-ω]$"), F.substr(F.lit(_ALPHABETS[0]), (F.pmod(n, F.lit(26)) + 1).cast("int"), F.lit(1))).otherwise(out)
        return F.when(i < keep, c).otherwise(out)

    return F.array_join(F.transform(_chars(value), char), "")


def _luhn_rest(digits: Column) -> Column:
    """Sum of the check digit's rule over an array of digits, the last of which is not doubled."""
    def add(acc: Column, d: Column) -> Column:
        twice = d * 2
        return F.struct((acc["s"] + F.when(acc["odd"], F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)).alias("s"), (~acc["odd"]).alias("odd"))
    zero = F.struct(F.lit(0).alias("s"), F.lit(False).alias("odd"))
    return F.aggregate(F.reverse(digits), zero, add, lambda a: a["s"] % 10)


def _digits(value: Column) -> Column:
    return F.transform(_chars(value), lambda c: c.try_cast("int"))


def _surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The attempt's surrogate of a folded value."""
    none = F.lit(0)
    plain = _generic(key, kind, value, attempt, none)
    card = _generic(key, kind, value, attempt, F.lit(1))
    body = F.substr(card, F.lit(1), F.char_length(card) - 1)
    fitting = F.pmod(_luhn_rest(_digits(value)) - _luhn_rest(_digits(F.concat(body, F.lit("0")))), F.lit(10))
    octets = F.transform(F.split(value, r"\."), lambda o, i: F.when((F.char_length(o) == 1) & (attempt < SAME_SHAPE), F.pmod(_draw(key, value, attempt, i), F.lit(9)) + 1)
                         .when((F.char_length(o) == 2) & (attempt < SAME_SHAPE), F.pmod(_draw(key, value, attempt, i), F.lit(90)) + 10).otherwise(F.pmod(_draw(key, value, attempt, i), F.lit(156)) + 100).cast("string"))
    cyrillic = value.rlike(_CYRILLIC)

    def pick(names: list[str], n: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x.lower()) for x in names]), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))

    def syllables(script: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), 3 + (attempt / 2).cast("int")), lambda i: pick(_SYLLABLES[script], _draw(key, kind, value, attempt, i))), "")

    surname = F.when(cyrillic, syllables("cyrillic")).otherwise(syllables("latin"))
    n = _draw(key, kind, value, attempt)
    given = F.when(kind == "given f", F.when(cyrillic, pick(GIVEN["cyrillic f"], n)).otherwise(pick(GIVEN["latin f"], n))) \
        .otherwise(F.when(cyrillic, pick(GIVEN["cyrillic m"], n)).otherwise(pick(GIVEN["latin m"], n)))
    given = F.when(attempt < 2, given).otherwise(F.concat(given, F.lit("-"), surname))
    out = F.when(kind == "card", F.concat(body, fitting.cast("string"))).when(kind == "ip", F.array_join(octets, ".")).when(kind == "surname", surname) \
        .when(kind.startswith("given"), given).when(kind == "phone", _generic(key, kind, value, attempt, F.when(F.char_length(value) > 10, F.char_length(value) - 10).otherwise(none))) \
        .when(kind == "iban", _generic(key, kind, value, attempt, F.lit(2))).when(value.rlike("^(?:AKIA|gh[pousr]_|sk-|eyJ)"), _generic(key, kind, value, attempt, F.lit(4))).otherwise(plain)
    # short parts have few others of their shape: after some draws they grow
    grow = (attempt >= SAME_SHAPE) & kind.isin("box", "host", "secret")
    return F.when(grow, F.concat(out, F.lpad(F.pmod(n, F.lit(100000)).cast("string"), 5, "0"))).otherwise(out)


def dictionary(values: DataFrame, key: str) -> DataFrame:
    """kind, value (folded, distinct) -> kind, value, surrogate: distinct within a kind, and never a value of that kind.

    Earlier draws stay; of the parts that draw the same at once, the smallest keeps it. Each round is a table, and what is left over shrinks fast."""
    drawn = stored(values.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))), "drawn")
    while True:
        best = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("b"), F.count("*").alias("n"))
        taken = drawn.select("kind", F.col("value").alias("surrogate")).withColumn("real", F.lit(True))
        bad = best.join(taken, ["kind", "surrogate"], "left").where("n > 1 or real")
        losers = stored(drawn.join(bad, ["kind", "surrogate"]).where(F.col("real").isNotNull() | (F.col("value") != F.col("b.value"))).select("kind", "value"), "losers")
        if losers.isEmpty():
            return drawn.select("kind", "value", "surrogate")
        again = drawn.join(losers.withColumn("lost", F.lit(True)), ["kind", "value"], "left")
        tries = F.col("attempt") + F.when(F.col("lost"), 1).otherwise(0)
        fresh = F.when(F.col("lost"), _surrogate(key, F.col("kind"), F.col("value"), tries)).otherwise(F.col("surrogate"))
        drawn = stored(again.select("kind", "value", tries.alias("attempt"), fresh.alias("surrogate")), "drawn")


def _dressed(kind: Column, original: Column, surrogate: Column) -> Column:
    """The surrogate with the original's case or separators."""
    letters = original.rlike(r"\p{L}")
    cased = F.when(letters & (original == F.upper(original)), F.upper(surrogate)).when(original.rlike(r"^\p{Lu}"), F.initcap(surrogate)).otherwise(surrogate)
    marks = _chars(original)
    step = F.aggregate(marks, F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), lambda a, c: F.when(
        c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(a["out"], F.substr(surrogate, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))), lambda a: a["out"])
    return F.when(kind.isin("box", "host", "given f", "given m", "surname"), cased).when(kind.isin("card", "iban", "phone", "ssn"), step).otherwise(surrogate)


def _name(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit("|"), _folded(kind, value))


def replace_private(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """docs with its text's private data replaced, and n_replaced (long), the number of mentions.

    Documents without private data stay as they are; a null text stays null. Repeated rows get equal texts. Other columns are carried."""
    docs = docs.drop("n_replaced")
    held = docs.select("text", whole_row(docs).alias("_row"), mentions(F.coalesce("text", F.lit(""))).alias("_found"))
    # the clean ones are not moved
    clean = held.where(F.size("_found") == 0).select("_row.*", F.lit(0).cast("long").alias("n_replaced"))
    private = stored(held.where(F.size("_found") > 0).select("_row", "_found", "text", F.xxhash64("text").alias("_key")), "private")
    in_text = private.select("_key", F.explode(F.flatten(F.transform("_found", parts))).alias("p")).where("p.kind <> ''")
    in_text = in_text.select("_key", F.col("p.kind").alias("kind"), _folded(F.col("p.kind"), F.col("p.value")).alias("value")).distinct()
    wanted = stored(in_text, "mentions")
    known = stored(dictionary(wanted.select("kind", "value").distinct(), key), "dictionary")
    # a text's map holds its own parts only
    maps = wanted.join(known, ["kind", "value"]).groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct(F.concat("kind", F.lit("|"), "value"), "surrogate"))).alias("_map"))
    both = private.join(maps, "_key")
    fresh = F.transform("_found", lambda m: F.array_join(F.transform(parts(m), lambda p: F.when(p["kind"] == "", p["value"]).otherwise(
        _dressed(p["kind"], p["value"], F.element_at(F.col("_map"), _name(p["kind"], p["value"]))))), ""))
    between = F.split(F.col("text"), ANY, -1)
    text = F.array_join(F.zip_with(between, fresh, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = both.select(F.col("_row").withField("text", text).alias("_row"), F.size("_found").cast("long").alias("n_replaced"))
    return clean.unionByName(done.select("_row.*", "n_replaced"))
