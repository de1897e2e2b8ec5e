"""Surrogates for personal data and secrets, with SQL expressions alone.

Every detected entity is replaced by one of its type, script and format. What is replaced as a whole is a *unit*: an e-mail address, a
number, a secret, or one word of a person's name, so a surname has one surrogate whatever stands before it. The surrogate of a unit is a
keyed cipher within classes of characters (digits, vowels or consonants of a script, small or capital, or the letters of any other
script): first its last letter or digit moves, by an amount that is never 0 and that a hash of the key and all the rest gives; then
every other one moves by an amount that depends on the new last one and on what stands before it. Whoever has the key can undo
that step by step, so equal units get equal surrogates in every document, different ones different ones, and none stays as it
is. Forms of address stay, and so does the last letter of a longer name, which often marks its gender.

A surrogate could still be what another unit of the corpus really is. All distinct units are therefore looked up among all surrogates
(both partly aggregated first); for those that are hit other surrogates are tried with further keys, and taken if they are neither a
unit nor another unit's surrogate. After ``ATTEMPTS`` of them - where a format has hardly any other values - the first one stays:
surrogates stay distinct, and ``audit`` counts what is left.

The expressions but for that lookup can be written in Spark's SQL and in DuckDB's, which the tests compare, beside a plain Python version.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace, free_name

#: Further keys that are tried for a surrogate that is another unit.
ATTEMPTS = 6
#: Forms of address, which give a name's gender, and the letter classes of the scripts.
TITLES = ["Mrs", "Mr", "Miss", "Ms", "Dr", "Prof", "Herr", "Frau", "Señora", "Señor", "Sra", "Sr", "Monsieur", "Madame", "Mme", "Господин", "Госпожа"]
GIVEN_NAMES = ["Anna", "Maria", "Emma", "Laura", "Sarah", "Mary", "Jane", "Alice", "Sophie", "Claire", "Marie", "Camille", "Carmen", "Lucía", "Sofía", "Ana", "Greta", "Ingrid", "Анна", "Мария", "Ольга", "Елена"]
GIVEN_NAMES += ["John", "James", "Peter", "Paul", "Thomas", "David", "Michael", "Robert", "Hans", "Jürgen", "Klaus", "Pierre", "Jean", "Louis", "José", "Juan", "Carlos", "Pedro", "Иван", "Пётр", "Сергей", "Алексей"]
DIGITS = "0123456789"
HEX = "abcdef"
LATIN = "abcdefghijklmnopqrstuvwxyz"
VOWELS = "aeiouy"
CONSONANTS = "bcdfghjklmnpqrstvwxz"
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûü"
MARKED = "çñ"
CYRILLIC_VOWELS = "аеиоуыэюя"
CYRILLIC_CONSONANTS = "бвгджзйклмнпрстфхцчшщ"
GREEK_VOWELS = "αεηιουωάέήίόύώ"
GREEK_CONSONANTS = "βγδζθκλμνξπρστφχψ"



def _any_of(words: list[str]) -> str:
    """A pattern of any of the words that looks at each first letter once, so it fails fast almost everywhere."""
    tails: dict[str, list[str]] = {}
    for word in words:
        tails.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(first + (f"(?:{'|'.join(rest)})" if len(rest) > 1 else rest[0]) for first, rest in tails.items()) + ")"


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = f"{_any_of(TITLES)}[.]? "
#: One alternative per form, the first that matches counts. No look-around and no word boundaries, so every engine agrees.
PATTERNS = {
    "email": "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63})+",
    "person": f"(?:{_TITLE}" + r"\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){0,2}" + f"|{_any_of(GIVEN_NAMES)}" + r"(?:[ -]\p{Lu}\p{Ll}+){1,2})",
    "ip": f"(?:{_OCTET}[.]){{3}}{_OCTET}",
    "phone": "[+][0-9]{1,3}[^0-9A-Za-z\\n]{1,8}[0-9]{2,4}[^0-9A-Za-z\\n]{1,8}[0-9]{3,4}[^0-9A-Za-z\\n]{1,4}[0-9]{3,4}|[(]?[0-9]{3}[)]?[ .-][0-9]{3}[.-][0-9]{4}",
    "secret": "[0-9A-Fa-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}",
    "number": "[0-9]{13,}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
ENTITY = "|".join(PATTERNS.values())


class Dialect:
    """What differs between the SQL of the two engines."""

    def __init__(self, duckdb: bool):
        self.duckdb = duckdb

    def literal(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'" if self.duckdb else "r'" + text + "'"

    def matches(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, {self.literal(pattern)})" if self.duckdb else f"({text} rlike {self.literal(pattern)})"

    def extract(self, text: str, pattern: str) -> str:
        return f"regexp_extract({text}, {self.literal(pattern)}, 0)"

    def extract_all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.literal(pattern)}" + (")" if self.duckdb else ", 0)")

    def split(self, text: str, pattern: str) -> str:
        return f"string_split_regex({text}, {self.literal(pattern)})" if self.duckdb else f"split({text}, {self.literal(pattern)}, -1)"

    def digits(self, text: str) -> str:
        return f"regexp_replace({text}, '[^0-9]', ''" + (", 'g')" if self.duckdb else ")")

    def transform(self, items: str, name: str, body: str) -> str:
        return f"list_transform({items}, lambda {name}: {body})" if self.duckdb else f"transform({items}, {name} -> {body})"

    def numbers(self, last: str) -> str:
        return f"range(1, {last} + 1)" if self.duckdb else f"sequence(1, {last})"

    def join(self, items: str, by: str = "") -> str:
        return f"array_to_string({items}, '{by}')" if self.duckdb else f"array_join({items}, '{by}')"

    def item(self, items: str, i: str) -> str:
        return f"{items}[{i}]" if self.duckdb else f"element_at({items}, cast({i} as int))"

    def part(self, text: str, i: str) -> str:
        return f"split_part({text}, '.', cast({i} as int))"

    def hash(self, text: str) -> str:
        digest = f"substr(md5({text}), 1, 8)"
        return f"cast('0x' || {digest} as bigint)" if self.duckdb else f"cast(conv({digest}, 16, 10) as bigint)"

    def let(self, name: str, value: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]" if self.duckdb else f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def zipped(self, gaps: str, items: str) -> str:
        """The items between their gaps, of which there is one more."""
        if self.duckdb:
            return self.join(self.transform(self.numbers(f"len({gaps})"), "m", f"{gaps}[m] || coalesce(({items})[m], '')"))
        return self.join(f"zip_with({gaps}, concat({items}, array('')), (g, s) -> concat(g, s))")

    def int(self, text: str) -> str:
        return f"cast({text} as bigint)"


def _classes(kind: str) -> list[str]:
    lower = {"secret": [HEX, LATIN[6:]], "person": [VOWELS, CONSONANTS, ACCENTED, MARKED, CYRILLIC_VOWELS, CYRILLIC_CONSONANTS, GREEK_VOWELS, GREEK_CONSONANTS]}.get(kind, [LATIN])
    lower = lower if kind in ("email", "secret", "person") else []
    return [DIGITS, *lower, *(c.upper() for c in lower)]


@functools.cache
def _other_letters() -> list[str]:
    """The letters of no class above, by script and case; those of scripts with one such letter together."""
    known = {c for s in _classes("person") for c in s}
    groups: dict[tuple[str, str], str] = defaultdict(str)
    for c in map(chr, range(sys.maxunicode + 1)):
        case = unicodedata.category(c)
        if case in ("Ll", "Lu") and c not in known:
            groups[unicodedata.name(c).split()[0], case] += c
    single = {case: "".join(s for (_, k), s in groups.items() if k == case and len(s) == 1) for case in ("Ll", "Lu")}
    return [s for s in [*groups.values(), *single.values()] if len(s) > 1]


def _cipher(d: Dialect, kind: str, key: str, e: str, low: str, high: str) -> str:
    """The unit ``e`` with the characters after ``low`` and up to ``high`` moved; without a letter or digit there, its last one anywhere."""
    letter = {"person": r"\p{L}", "email": "[0-9A-Za-z]", "secret": "[0-9A-Za-z]"}.get(kind, "[0-9]")
    known = (lambda text: d.digits(text)) if kind in ("phone", "number") else (lambda text: f"lower({text})")
    classes = _classes(kind) + (_other_letters() if kind == "person" else [])

    def moved(c: str, amount) -> str:
        cases = " ".join(f"when instr('{s}', {c}) > 0 then substr('{s}', cast((instr('{s}', {c}) - 1 + {amount(len(s))}) % {len(s)} as int) + 1, 1)" for s in classes)
        return f"case {cases} else {c} end"

    place = lambda text: f"length({d.extract(text, f'(?s)^.*{letter}')})"
    last = f"coalesce(nullif({place(f'substr({e}, 1, cast({high} as int))')}, 0), {place(e)})"
    rest = known(f"concat(substr({e}, 1, cast(p - 1 as int)), '|', substr({e}, cast(p + 1 as int)))")
    end = moved(f"substr({e}, cast(p as int), 1)", lambda n: f"1 + {d.hash(f'concat({chr(39)}{key}{kind} last:{chr(39)}, {rest})')} % {n - 1}")
    before = known(f"substr({e}, 1, cast(i as int) - 1)")
    shift = d.hash(f"concat('{key}{kind}:', lower(z), ':', {before})")
    c = f"substr({e}, cast(i as int), 1)"
    one = f"case when i = p then z when i <= {low} or i > {high} then {c} else {moved(c, lambda n: shift)} end"
    return d.let("p", last, d.let("z", end, d.join(d.transform(d.numbers(f"length({e})"), "i", one))))


def _ip(d: Dialect, key: str, e: str) -> str:
    """Four numbers: the last one moves by the others, the others by it and what stands before them."""
    number = lambda i: d.int(d.part(e, i))
    text = lambda x: f"cast({x} as varchar)" if d.duckdb else f"cast({x} as string)"
    three = d.join(d.transform(d.numbers("3"), "j", d.part(e, "j")), ".")
    end = text(f"({number('4')} + 1 + {d.hash(f'concat({chr(39)}{key}ip last:{chr(39)}, {three})')} % 255) % 256")
    before = d.join(d.transform(d.numbers("i"), "j", f"case when j < i then {d.part(e, 'j')} else '' end"), ".")
    one = f"case when i = 4 then z else {text(f'({number("i")} + {d.hash(f"concat({chr(39)}{key}ip:{chr(39)}, z, {chr(39)}:{chr(39)}, {before})")}) % 256')} end"
    return d.let("z", end, d.join(d.transform(d.numbers("4"), "i", one), "."))


def surrogate(d: Dialect, key: str, e: str) -> str:
    """The expression of the surrogate of a unit that is no name."""
    whole = f"length({e})"
    last_label = f"{whole} - length({d.extract(e, '[.][A-Za-z0-9-]+$')})"
    country = f"length({d.extract(e, '^[+][0-9]*')})"
    kinds = [
        (d.matches(e, "@"), _cipher(d, "email", key, e, "0", last_label)),
        (d.matches(e, f"^{PATTERNS['ip']}$"), _ip(d, key, e)),
        (d.matches(e, f"^(?:{PATTERNS['secret']})$"), _cipher(d, "secret", key, e, f"length({d.extract(e, '^(?:AKIA|gh[pousr]_|sk-)')})", whole)),
        (d.matches(e, f"^(?:{PATTERNS['phone']})$"), _cipher(d, "phone", key, e, country, whole)),
    ]
    return "case " + " ".join(f"when {test} then {new}" for test, new in kinds) + f" else {_cipher(d, 'number', key, e, '0', whole)} end"


def name_surrogate(d: Dialect, key: str, w: str) -> str:
    """The expression of the surrogate of one word of a name; from three letters on its last one stays."""
    return _cipher(d, "person", key, w, "0", f"(length({w}) - case when length({w}) > 2 then 1 else 0 end)")


#: The words of a name, and an expression that is true for names.
_WORD = "[^ -]+"
_PERSON = f"^(?:{PATTERNS['person']})$"


def _words_of(d: Dialect, e: str) -> tuple[str, str]:
    """The form of address of a person, and the rest."""
    title = d.extract(e, f"^{_TITLE}")
    return title, f"substr({e}, cast(length({title}) + 1 as int))"


def entity_surrogate(d: Dialect, key: str, e: str, known: str | None = None) -> str:
    """The expression of an entity's surrogate; known: a map of units (with a mark for words of names) to surrogates that go before."""
    first = lambda mark, unit, new: f"coalesce(element_at({known}, concat('{mark}', {unit})), {new})" if known else new
    title, rest = _words_of(d, e)
    names = d.transform(d.extract_all("r", _WORD), "w", first("n:", "w", name_surrogate(d, key, "w")))
    person = f"concat({title}, {d.let('r', rest, d.zipped(d.split('r', _WORD), names))})"
    return f"case when {d.matches(e, _PERSON)} then {person} else {first('u:', e, surrogate(d, key, e))} end"


def _found(df: DataFrame, text_col: str, entities: str) -> DataFrame:
    d = Dialect(duckdb=False)
    text = f"cast(`{text_col}` as string)"
    could = d.matches(text, f"[0-9@]|{_TITLE}|{_any_of(GIVEN_NAMES)}[ -]|[A-Fa-f]{{32}}|AKIA|gh[pousr]_|sk-")
    return df.withColumn(entities, F.expr(f"coalesce(case when {could} then {d.extract_all(text, ENTITY)} end, cast(array() as array<string>))"))


def _units_of(found: DataFrame, entities: str) -> DataFrame:
    d = Dialect(duckdb=False)
    each = found.select(F.explode(entities).alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    _, rest = _words_of(d, "e")
    parts = F.expr(f"case when {d.matches('e', _PERSON)} then transform({d.extract_all(rest, _WORD)}, w -> concat('n:', w)) else array(concat('u:', e)) end")
    return each.select(F.explode(parts).alias("unit"), "n").groupBy("unit").agg(F.sum("n").alias("n"))


def units(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(unit, n): the distinct units of a corpus, marked n: for words of names and u: for others, and how often they occur."""
    entities = free_name("the_entities", df)
    return _units_of(_found(df, text_col, entities), entities)


def _of_unit(key: str) -> F.Column:
    """The surrogate of a marked unit, marked too."""
    d, e = Dialect(duckdb=False), "substr(unit, 3)"
    return F.expr(f"concat(substr(unit, 1, 2), {d.let('u', e, f'case when substr(unit, 1, 2) = {chr(39)}n:{chr(39)} then {name_surrogate(d, key, chr(117))} else {surrogate(d, key, chr(117))} end')})")


def exceptions(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(unit, new): units whose first surrogate is another unit of the corpus, and the ones that are used instead."""
    return _exceptions(units(df, text_col), key)


def _exceptions(corpus: DataFrame, key: str) -> DataFrame:
    work = Workspace(corpus.sparkSession, "surrogates")
    known = work.save(corpus.select("unit", _of_unit(key).alias("new")))
    taken = known.select("unit").unionAll(known.select(F.col("new").alias("unit")))
    pending = work.save(known.join(known.select(F.col("unit").alias("new")), "new", "left_semi").select("unit"))
    done = None
    for attempt in range(1, ATTEMPTS + 1):
        if pending.isEmpty():
            break
        tried = work.save(pending.select("unit", _of_unit(f"{key}{attempt}").alias("new")))
        free = tried.join(taken.select(F.col("unit").alias("new")), "new", "left_anti").groupBy("new").agg(F.min("unit").alias("unit")).select("unit", "new")
        free = work.save(free)
        done = free if done is None else done.unionAll(free)
        taken = taken.unionAll(free.select(F.col("new").alias("unit")))
        pending = work.save(pending.join(free.select("unit"), "unit", "left_anti"))
    return done if done is not None else known.select("unit", "new").limit(0)


RESULT = "entities"


def replace_entities(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with surrogates in ``text_col``, and entities, those found, in order.

    Null text stays null, without entities; texts without any stay as they are. Entities in one text or in several that
    are equal but for letter case, or phone and card numbers that are equal but for separators, get surrogates with
    the same relation, unless one of them had to be given another. Repeated rows get the same result; an empty table gives no rows; other
    columns are passed through, one named entities gives way to the result's. ``key`` must be kept secret and is plain text without
    quotes.
    """
    if not key.isalnum():
        raise ValueError("the key must be letters and digits")
    d = Dialect(duckdb=False)
    text = f"cast(`{text_col}` as string)"
    # the patterns are what is dear: they go over the texts once
    found = Workspace(df.sparkSession, "entities").save(_found(df.drop(RESULT) if text_col != RESULT else df, text_col, RESULT))
    replaced = lambda known: F.expr(f"case when size({RESULT}) = 0 then {text} else {d.zipped(d.split(text, ENTITY), d.transform(RESULT, 'e', entity_surrogate(d, key, 'e', known)))} end")
    odd = _exceptions(_units_of(found, RESULT), key)
    if odd.isEmpty():
        return found.withColumn(text_col, replaced(None))
    # texts with such units get a map of them, found by the text itself; only texts with entities are joined
    digest, known, unit = (free_name(n, df) for n in ("the_digest", "the_map", "the_unit"))
    touched = found.where(F.size(RESULT) > 0).withColumn(digest, F.expr(f"sha2({text}, 256)"))
    _, rest = _words_of(d, "e")
    parts = f"flatten(transform({RESULT}, e -> case when {d.matches('e', _PERSON)} then transform({d.extract_all(rest, _WORD)}, w -> concat('n:', w)) else array(concat('u:', e)) end))"
    pairs = touched.select(digest, F.explode(F.expr(f"array_distinct({parts})")).alias("unit")).distinct().join(odd, "unit")
    maps = pairs.groupBy(digest).agg(F.map_from_entries(F.collect_list(F.struct(F.col("unit"), F.expr("substr(new, 3)")))).alias(known))
    mapped = touched.join(maps, digest, "left").withColumn(known, F.coalesce(known, F.expr("cast(map() as map<string, string>)")))
    others = found.where(F.size(RESULT) == 0).withColumn(text_col, F.expr(text))
    return mapped.withColumn(text_col, replaced(f"`{known}`")).select(*found.columns).unionAll(others)


def audit(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """One row: n_units, n_distinct, n_surrogates (distinct ones), n_unchanged, collisions (distinct units that share a surrogate of
    another; 0 is right), n_real (surrogates that are units of the corpus)."""
    rows = units(df, text_col).join(exceptions(df, key, text_col), "unit", "left").withColumn("s", F.coalesce("new", _of_unit(key)))
    real = rows.join(rows.select(F.col("unit").alias("s")), "s", "left_semi").agg(F.count("*").alias("n_real"))
    by_surrogate = rows.groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.when(F.col("unit") == F.col("s"), 1).otherwise(0)).alias("same"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_surrogate.agg(
        total("n").alias("n_units"),
        total("k").alias("n_distinct"),
        F.count("*").alias("n_surrogates"),
        total("same").alias("n_unchanged"),
        total(F.col("k") - 1).alias("collisions"),
    ).withColumn("n_real", real.scalar())


def oracle(key: str) -> str:
    """DuckDB SQL for op9's rows, where no surrogate is another unit."""
    d = Dialect(duckdb=True)
    return f"""
        with found as (select doc_id, text, {d.extract_all("text", ENTITY)} as entities from documents)
        select doc_id, coalesce(len(entities), 0)::bigint as n_entities, coalesce(len(entities), 0) > 0 as changed,
          case when coalesce(len(entities), 0) = 0 then text else {d.zipped(d.split("text", ENTITY), d.transform("entities", "e", entity_surrogate(d, key, "e")))} end as text
        from found"""
