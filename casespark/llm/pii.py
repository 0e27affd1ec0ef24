"""Surrogates for personal data (DataFrame operations only).

Entities are found by patterns (and checksums of card and account numbers) and replaced by surrogates of their type
and format: the digits of a phone number, identity number or card keep their separators, phone numbers their country
code, cards their first digit, account numbers their country, both a right check digit; names keep title, gender,
script and capitals, e-mail addresses and secrets their shape, known keys their prefix.  A surrogate is a function of
the secret key and the canonical entity, so every mention in the corpus gets the same one.  The table of distinct
entities is checked in rounds: a surrogate that two entities share, or that is itself an entity of the corpus, is drawn
anew until none is left, so different entities stay different.

Names are known by their words.  A word of a name has one surrogate whatever the title and its place, so "Mrs. Alice
Smith", "Dr. Alice Smith", "Alice Smith", "Ms Alice" and "Smith" agree.  Its form (a woman's, a man's or a neutral first
name, or a surname) follows the majority of its mentions with a title.  Names start with a title; the full names and
name words so found are names in the rest of their document too, wherever they stand with the same capitals.  A word
that the document also writes in lower case ("Will", "Brown") counts only beside its title or in its full name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casespark.llm.shared import Scratch

# Titles by gender, syllables and endings of invented names by script.
MALE = ["Mr", "Herr", "Señor", "señor", "Sr", "Monsieur", "monsieur", "Господин", "Г-н", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "señora", "Sra", "Mme", "Mlle", "Madame", "madame", "Госпожа", "Г-жа", "г-жа"]
NEUTRAL = ["Dr", "Prof"]
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "ta", "ve", "wi", "zo", "bra", "cle"],
             "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "пи", "ро", "су", "та", "ве", "ви", "зо", "бра", "кле"]}
ENDINGS = {"latin": {"m": "n", "f": "na", "n": "l", "s": "rson"}, "cyrillic": {"m": "н", "f": "на", "n": "л", "s": "рко"}}

#: beginnings of keys that are known by them
KEYS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxb-", "xoxp-"]

_WORD = r"\p{Lu}(?:\p{L}+(?:['-]\p{Lu}\p{L}+)*|(?:['-]\p{Lu}\p{L}+)+)"
_TITLES = "|".join(MALE + FEMALE + NEUTRAL)
_TITLE = rf"(?:(?:(?:{_TITLES})\.?|M\.) )"
_KEYS = "|".join(KEYS)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUP = r"[\dA-Fa-f]{1,4}"
NAME = rf"(?<![\p{{L}}\d]){_TITLE}+{_WORD}(?: {_WORD})?"
EMAIL = r"(?<![\p{L}\d._%+-])[\p{L}\d._%+-]++@[A-Za-z\d-]+(?:\.[A-Za-z\d-]+)*\.[A-Za-z]{2,}"
SECRET = (r"(?<!\p{L})(?i:token|secret|password|passwd|api[_-]?key) ?[=:] ?"
          r"(?:[\"'][^\"'\s]{8,}[\"']|(?=[^\"'\s,;]*\d)[^\"'\s,;]{8,})")
KNOWN_KEY = rf"(?<![\w-])(?:{_KEYS})[\w-]{{16,}}"
IP = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)"
IP6 = rf"(?<![\w:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![\w:])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
WORLD_PHONE = r"(?<![\w+])\+\d{1,3}[ .-](?:\(?\d{1,6}\)?[ .-]?){1,4}\d{2,8}(?!\w)"
IDENTITY = r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)"
ACCOUNT = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?!\w)"
CARD = r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)"
ENTITY = "|".join([SECRET, KNOWN_KEY, EMAIL, NAME, IP6, IP, PHONE, WORLD_PHONE, IDENTITY, ACCOUNT, CARD])
#: no entity without one of these; spares most texts the full pattern
HINT = rf"[@\d]|(?<!\p{{L}}){_TITLE}|[\"'][^\"'\s]{{8}}|{_KEYS}"
ROUNDS = 64


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sum_of_digits(digits: str, doubled: int) -> str:
    """Checksum of a digit string; every second digit counts double, from the last (0) or the last but one (1)."""
    d = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    twice = f"if({d} > 4, 2 * {d} - 9, 2 * {d})"
    return (f"aggregate(transform(sequence(0, length({digits}) - 1), i -> if(i % 2 = {doubled}, {twice}, {d})), 0,"
            " (a, x) -> a + x)")


def _remainder_97(account: str) -> str:
    """Of an account number with its first four characters moved to the end and letters read as 10 to 35."""
    return (f"aggregate(split(concat(substr({account}, 5), left({account}, 4)), ''), 0, (a, c) -> if(c BETWEEN '0' AND '9', "
            "(a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))")


def mentions_pattern(text: Column) -> Column:
    """Pattern of the entities of a text: the common one, and the names that the text gives with a title."""
    full = F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), lambda e: F.regexp_replace(e, f"^{_TITLE}+", ""))
    words = F.array_distinct(F.flatten(F.transform(full, lambda f: F.split(f, " "))))

    def unambiguous(w: Column) -> Column:
        lower = F.lower(w)
        return (F.instr(text, lower) == 0) | ~F.regexp_like(text, F.concat(F.lit(r"(?<!\p{L})"), lower, F.lit(r"(?!\p{L})")))

    names = F.array_distinct(F.concat(F.filter(full, lambda f: F.contains(f, F.lit(" "))), F.filter(words, unambiguous)))
    return F.when(F.size(names) == 0, F.lit(ENTITY)).otherwise(F.concat(
        F.lit(ENTITY + r"|(?<![\p{L}\d-])(?=\p{Lu})(?:"), F.array_join(names, "|"), F.lit(r")(?!-?[\p{L}\d])")))


def segments() -> Column:
    """Per entity: array of (kind, canon, raw, mark); kind is null for what stays as it is.

    The mark of a word of a name: m, f, n (first of two words, by the title), s (second of two), null (alone)."""
    digits = r"regexp_replace(e, '[^0-9]', '')"
    card = f"(length({digits}) BETWEEN 13 AND 19 AND {_sum_of_digits(digits, 1)} % 10 = 0)"
    none = "cast(null as string)"
    keep = f"struct({none} AS kind, {none} AS canon, {{0}} AS raw, {none} AS mark)"
    part = f"struct({{0}} AS kind, {{1}} AS canon, {{2}} AS raw, {none} AS mark)"

    def one(kind: str, canon: str) -> str:
        return f"array({part.format(_lit(kind), canon, 'e')})"

    title = f"regexp_extract(e, {_lit(f'^{_TITLE}*')}, 0)"
    words = f"split(substr(e, length({title}) + 1), ' ')"

    def titled(titles: list[str], more: str = "") -> str:
        return f"{title} RLIKE {_lit(rf'(?:^| )(?:(?:{chr(124).join(titles)})[.]? {more})')}"

    gender = f"CASE WHEN {titled(MALE, '|M[.] ')} THEN 'm' WHEN {titled(FEMALE)} THEN 'f' WHEN {title} <> '' THEN 'n' END"

    def word(w: str, mark: str) -> str:
        script = f"if({w} RLIKE '[\\\\u0400-\\\\u04FF]', 'name-cyrillic', 'name-latin')"
        return f"struct({script} AS kind, lower({w}) AS canon, {w} AS raw, {mark} AS mark)"

    first, last = f"element_at({words}, 1)", f"element_at({words}, -1)"
    name = (f"if(size({words}) = 1, array({keep.format(title)}, {word(last, none)}), array({keep.format(title)}, "
            f"{word(first, '(' + gender + ')')}, {keep.format(_lit(' '))}, {word(last, f'if({title} <> {_lit(str())}, {_lit(chr(115))}, null)')}))")
    quoted = "regexp_extract(e, '^[^\"\\']*[\"\\']', 0)"
    value = f"substr(e, length({quoted}) + 1, length(e) - length({quoted}) - 1)"
    secret = f"array({keep.format(quoted)}, {part.format(_lit('secret'), value, value)}, {keep.format('right(e, 1)')})"

    def after(opening: str) -> str:
        rest = f"substr(e, length({opening}) + 1)"
        return f"array({keep.format(opening)}, {part.format(_lit('secret'), rest, rest)})"

    assigned = "regexp_extract(e, '^[^=:]*[=:] ?', 0)"
    prefix = f"regexp_extract(e, {_lit(f'^(?:{_KEYS})')}, 0)"
    national = "regexp_replace(regexp_replace(e, '^[+][0-9]+', ''), '[^0-9]', '')"
    account = "replace(e, ' ', '')"
    return F.expr(f"""CASE
        WHEN e RLIKE {_lit('^' + SECRET + '$')} THEN if(right(e, 1) IN ('"', '\\''), {secret}, {after(assigned)})
        WHEN e RLIKE {_lit('^' + KNOWN_KEY + '$')} THEN {after(prefix)}
        WHEN e LIKE '%@%' THEN {one('email', 'lower(e)')}
        WHEN e RLIKE {_lit(f'^{_TITLE}*{_WORD}(?: {_WORD})?$')} THEN {name}
        WHEN e RLIKE {_lit('^' + IP6 + '$')} AND e RLIKE '[0-9]' THEN {one('ip6', 'lower(e)')}
        WHEN e RLIKE {_lit('^' + IP + '$')} THEN {one('ip', 'e')}
        WHEN e RLIKE {_lit('^' + PHONE + '$')} THEN {one('phone', f'right({digits}, 10)')}
        WHEN e LIKE '+%' AND length({national}) BETWEEN 6 AND 12 THEN {one('phone', national)}
        WHEN e RLIKE {_lit('^' + IDENTITY + '$')} THEN {one('identity', digits)}
        WHEN e RLIKE '^[A-Z]{{2}}' AND {_remainder_97(account)} = 1 THEN {one('account', account)}
        WHEN e RLIKE '^[0-9]' AND {card} THEN {one('card', digits)}
        ELSE array({keep.format('e')}) END""")


def surrogate(key: str) -> Column:
    """Surrogate of columns (kind, canon, form, attempt)."""
    digest = f"sha2(concat_ws('|', {_lit(key)}, kind, canon, cast(attempt as string)), 256)"
    number = "cast(conv(substr({d}, 1 + (({i}) * 3) % 61, 3), 16, 10) as int)"

    def shape(text: str, d: str) -> str:
        n = number.format(d=d, i="i")
        return (f"concat_ws('', transform(split({text}, ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN cast({n} % 10 as string) "
                f"WHEN c RLIKE '[a-z]' THEN char(97 + {n} % 26) WHEN c RLIKE '[A-Z]' THEN char(65 + {n} % 26) "
                f"WHEN c RLIKE '\\\\p{{L}}' THEN char(97 + {n} % 26) ELSE c END))")

    def digits(n: str) -> str:
        return f"concat_ws('', transform(sequence(0, {n} - 1), i -> cast({number.format(d='d', i='i')} % 10 as string)))"

    domain = "substring_index(canon, '@', -1)"
    domain_digest = f"sha2(concat_ws('|', {_lit(key)}, 'domain', {domain}), 256)"
    payload = f"concat(left(canon, 1), {digits('(length(canon) - 2)')})"
    n0 = number.format(d="d", i="0")
    octets = ", '.', ".join([f"cast(1 + {n0} % 223 as string)"] + [
        f"cast({number.format(d='d', i=str(i))} % 256 as string)" for i in (1, 2, 3)])
    # a shape with few forms may run out of free surrogates: later attempts are longer
    longer = "if(attempt < 8, '', lower(substr(d, 1, attempt div 8)))"

    def invented(script: str, ending: str) -> str:
        syllables = "array(" + ", ".join(map(_lit, SYLLABLES[script])) + ")"
        return (f"concat(concat_ws('', transform(sequence(0, 2 + attempt div 8), i -> element_at({syllables}, 1 + "
                f"{number.format(d='d', i='i')} % {len(SYLLABLES[script])}))), {_lit(ENDINGS[script][ending])})")

    names = " ".join(f"WHEN 'name-{s}' THEN CASE form " + " ".join(f"WHEN '{g}' THEN {invented(s, g)}" for g in "mfns") + " END"
                     for s in SYLLABLES)
    groups = ", ':', ".join(f"lower(substr(d, {1 + 4 * i}, 4))" for i in range(6))
    checked = "concat(left(canon, 2), '00', payload)"
    chosen = f"""CASE kind
        WHEN 'email' THEN concat({shape("substring_index(canon, '@', 1)", 'd')}, {longer}, '@', {shape(
            f"left({domain}, length({domain}) - length(substring_index({domain}, '.', -1)) - 1)", domain_digest)}, '.example')
        WHEN 'secret' THEN concat(if(canon RLIKE '^[0-9a-f]+$', concat_ws('', transform(sequence(0, length(canon) - 1),
            i -> substr(d, 1 + i % 64, 1))), {shape('canon', 'd')}), {longer})
        WHEN 'ip' THEN concat({octets})
        WHEN 'ip6' THEN concat('2001:db8:', {groups})
        WHEN 'account' THEN concat(left(canon, 2), lpad(cast(98 - {_remainder_97(checked)} as string), 2, '0'), payload)
        WHEN 'phone' THEN concat(cast(2 + {n0} % 8 as string), substr({digits('length(canon)')}, 2))
        WHEN 'identity' THEN concat('9', substr({digits('length(canon)')}, 2))
        WHEN 'card' THEN concat(payload, cast((10 - {_sum_of_digits('payload', 0)} % 10) % 10 as string))
        {names} END"""
    with_payload = chosen.replace("payload", "p")
    return F.expr(f"element_at(transform(array({digest}), d -> element_at(transform(array("
                  f"CASE kind WHEN 'card' THEN {payload} WHEN 'account' THEN {shape('substr(canon, 5)', 'd')} ELSE '' END), p -> {with_payload}), 1)), 1)")


def mapping(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canon, surrogate) of the distinct entities; surrogates of a kind are distinct and none is an entity.

    ``form`` is that of a word of a name: s where it is the second word more often than the first or stands alone,
    else m or f by the majority of its titles, else n."""
    marked = {m: F.count_if(F.col("mark") == m) for m in "mfns"}
    first = marked["m"] + marked["f"] + marked["n"]
    form = (F.when((first == 0) | (first < marked["s"]), "s").when(marked["m"] > marked["f"], "m")
            .when(marked["f"] > marked["m"], "f").otherwise("n"))
    current = scratch.table(entities.groupBy("kind", "canon").agg(form.alias("form")).withColumn("attempt", F.lit(0))
                            .withColumn("surrogate", surrogate(key)), "map-0")
    for k in range(1, ROUNDS):
        holders = current.groupBy("kind", "surrogate").agg(F.min("canon").alias("holder"))
        taken = current.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
        checked = (current.join(holders, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
                   .withColumn("attempt", F.col("attempt") + (
                       (F.col("holder") != F.col("canon")) | F.coalesce("taken", F.lit(False))).cast("int")))
        changed = scratch.table(checked.withColumn("fresh", surrogate(key))
                                .select("kind", "canon", "form", "attempt", F.col("fresh").alias("surrogate")), f"map-{k}")
        tried = [t.agg(F.sum("attempt")).first()[0] or 0 for t in (current, changed)]
        scratch.drop(f"map-{k - 1}")
        current = changed
        if tried[0] == tried[1]:
            return current.select("kind", "canon", "surrogate")
    raise ValueError("no free surrogates left for some kind of entity")


def rendered() -> Column:
    """The surrogate in the format of the mention: separators and country code of digits, capitals of words."""
    fill = ("aggregate(split(raw, ''), named_struct('s', '', 'k', length(surrogate) - length(regexp_replace(raw, '[^0-9]', ''))),"
            " (a, c) -> if(c RLIKE '[0-9]', named_struct('s', concat(a.s, if(a.k < 0, c, substr(surrogate, a.k + 1, 1))), 'k', a.k + 1),"
            " named_struct('s', concat(a.s, c), 'k', a.k)), a -> a.s)")
    return F.expr(f"""CASE WHEN kind IN ('phone', 'identity', 'card') THEN {fill}
        WHEN kind = 'account' THEN aggregate(split(raw, ''), named_struct('s', '', 'k', 1),
            (a, c) -> if(c = ' ', named_struct('s', concat(a.s, c), 'k', a.k), named_struct('s', concat(a.s, substr(surrogate, a.k, 1)), 'k', a.k + 1)),
            a -> a.s)
        WHEN kind IN ('ip', 'ip6', 'secret') THEN surrogate
        WHEN length(raw) > 1 AND raw = upper(raw) AND raw <> lower(raw) THEN upper(surrogate)
        WHEN kind = 'email' THEN surrogate ELSE initcap(surrogate) END""")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text",
                 count_col: str = "n_entities") -> DataFrame:
    """The input rows and columns with entities of ``text_col`` replaced, and ``count_col``: how many were.

    A null text stays null with count 0; an empty text stays empty; rows without entities come through unchanged.
    Repeated rows are all kept and get the same text.  Only ``text_col`` changes; an input column named like
    ``count_col`` is replaced, all others pass through whatever their names.  An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    names = [c for c in docs.columns if c != count_col]
    text = F.col(text_col)
    has = F.coalesce(text.rlike(HINT) & text.rlike(ENTITY), F.lit(False))
    marked = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), has.alias("has"))
    plain = marked.where("NOT has").select("row.*", F.lit(0).alias(count_col))
    kept = F.col("row").getField(text_col)
    hits = scratch.table(marked.where("has").select(
        "row", F.concat_ws(":", F.col("row").getField(id_col).cast("string"), F.xxhash64(kept), F.xxhash64(F.lit(1), kept)).alias("at")), "hits")
    hit_text = F.col("row").getField(text_col)
    pieces = (hits.dropDuplicates(["at"])
              .select("at", hit_text.alias("text"), mentions_pattern(hit_text).alias("pattern"))
              .select("at", F.split("text", F.col("pattern"), -1).alias("between"),
                      F.regexp_extract_all("text", "pattern", F.lit(0)).alias("found"))
              .select("at", F.posexplode(F.arrays_zip("between", "found")).alias("i", "x"))
              .select("at", "i", F.col("x.between").alias("between"), F.col("x.found").alias("e"))
              .withColumn("parts", F.when(F.col("e").isNotNull(), segments())))
    parts = scratch.table(pieces.select("at", "i", "between", F.posexplode_outer("parts").alias("j", "part"))
                          .select("at", "i", F.coalesce("j", F.lit(0)).alias("j"), "between", "part.kind", "part.canon", "part.raw", "part.mark"), "parts")
    known = mapping(parts.where("kind IS NOT NULL"), key, scratch)
    before = F.when(F.col("j") == 0, F.col("between")).otherwise("")
    same = parts.where("kind IS NULL").select("at", "i", "j", F.concat(before, F.coalesce("raw", F.lit(""))).alias("s"), F.lit(0).alias("n"))
    new = parts.join(known, ["kind", "canon"]).select("at", "i", "j", F.concat(before, rendered()).alias("s"), F.lit(1).alias("n"))
    texts = (same.unionByName(new).groupBy("at")
             .agg(F.array_sort(F.collect_list(F.struct("i", "j", "s"))).alias("all"), F.sum("n").cast("int").alias("n"))
             .select("at", F.expr("concat_ws('', transform(all, x -> x.s))").alias("text"), "n"))
    done = hits.join(texts, "at").select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in names],
                                         F.col("n").alias(count_col))
    return plain.unionByName(done)
