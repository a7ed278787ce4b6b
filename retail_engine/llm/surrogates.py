"""Personal data replaced by surrogates: keyed, of the same type and form, distinct.

One pattern finds the mentions; a mention's canonical form is its entity, so that spellings
of one phone number or one name stay one. An entity's surrogate follows from the secret key,
its type and its form: digits for digits, letters for letters, given names of the same gender
and script, card numbers with a valid check digit where the original's is. Surrogates that
two entities share, or that are themselves entities of the corpus, are drawn again for all
but one of them until none is left. Each mention then takes its entity's surrogate in its own
spelling. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_engine.llm.common import packed, stored

# Given names by gender and script, and titles by gender.
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Charles Daniel Peter "
    "Paul Hans Klaus Pierre Jacques Carlos José Luis Miguel Stefan Andreas Martin Georg",
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Anna Maria Julia Laura Marie Claire Sophie Carmen Lucía Elena Petra Sabine Monika Ursula",
    ("m", "cyrillic"): "Иван Пётр Сергей Андрей Алексей Дмитрий Николай Михаил Владимир Борис",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
}
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Sir Господин",
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа",
    "n": "Dr Prof Professor",
}

_TOP = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts.split())
_FIRST = "|".join(n for ns in GIVEN.values() for n in ns.split())
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

# What a mention looks like, by type; the first that fits a mention names its type. All begin
# at a character that no letter, digit or underscore precedes, which is looked at once.
_START = r"(?<![\p{L}\p{N}_])"
_END = r"(?![\p{L}\p{N}_])"
_KEYWORD = r"(?i:token|api_key|secret|password|passwd) {0,2}[=:] {0,2}[\"']?"
PATTERNS = {
    "email": r"[A-Za-z0-9_.+%-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": rf"(?=\d)(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\.\d){_END}",
    "ssn": rf"(?=\d)(?<!-)\d{{3}}-\d{{2}}-\d{{4}}(?!-){_END}",
    "phone": r"(?=[\d+(])(?<!\+)(?:"
    r"\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}"
    rf"|(?<![.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?!-)){_END}",
    "card": rf"(?=\d)(?<!-)\d{{4}}(?:[ -]?\d{{4}}){{2}}[ -]?\d{{1,7}}(?!-){_END}",
    "iban": r"(?=[A-Z]{2}\d{2})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "secret": rf"{_KEYWORD}[^\s\"']{{8,}}+"
    r"|(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|[0-9a-fA-F]{32,}+)"
    + _END,
    "person": rf"(?=\p{{Lu}})(?:(?:{_TITLE})\.? {_TOP}(?: {_TOP})?|(?:{_FIRST}) {_TOP})",
}
# A letter, digit or one of few marks begins every mention.
PATTERN = (
    _START + r"(?=[\p{L}\p{N}_.+%(-])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
)

_SYLLABLES = {
    "latin": "an ber cor dal en fel gar hol in jen kar lin mar nor os pel ran sel tor un ver wen "
    "yor zel",
    "cyrillic": "ан бер вол гор дан ев жар зин кор лин мар нов ос пет ран сол тур ул фил хар цев "
    "чер шин юр",
}


def _sql_array(values: str) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values.split()) + ")"


def _alnum(text: str) -> str:
    return rf"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]', '')"


def _sum_of_check(digits: str) -> str:
    """Luhn sum of all digits, the last one counted once."""
    digit = f"cast(substr({digits}, -i, 1) as bigint)"
    return (
        f"aggregate(sequence(1, greatest(length({digits}), 1)), 0L, (a, i) -> a + "
        f"if(i % 2 = 1, {digit}, (2 * {digit}) div 10 + (2 * {digit}) % 10))"
    )


def mentions_of(text: Column) -> Column:
    """All mentions in a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _typed(mentions: DataFrame) -> DataFrame:
    """mention -> nth part, type, part, canonical form, gap between parts.

    A name's words are parts of their own, and so are a secret and the words that tell it.

    Sixteen digits whose check digit is wrong are no card and keep their form.
    """
    kind = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        fits = F.col("mention").rlike(f"^(?:{PATTERNS[name]})$")
        kind = F.when(fits, F.lit(name)).otherwise(kind)
    words = F.split("mention", " ")
    value = F.regexp_replace("mention", f"^{_KEYWORD}", "")
    told = (F.col("kind") == "secret") & (F.length(value) < F.length("mention"))
    parts = F.when(F.col("kind") == "person", words)
    words_before = F.expr("left(mention, length(mention) - length(value))")
    parts = parts.when(told, F.array(words_before, F.col("value")))
    df = mentions.withColumn("kind", kind).withColumn("value", value)
    df = df.select(
        "mention",
        "kind",
        F.posexplode(parts.otherwise(F.array("mention"))).alias("nth", "part"),
        F.size(words).alias("parts"),
        words[0].alias("first"),
        (told & (F.col("value") != "")).alias("told"),
    )
    cyrillic = F.col("part").rlike(r"\p{IsCyrillic}")
    script = F.when(cyrillic, "cyrillic").otherwise("latin")
    bare = F.regexp_replace("first", r"\.$", "")
    titled = F.array_contains(F.array(*[F.lit(t) for t in _TITLE.split("|")]), bare)
    gender = F.lit("n")
    for (g, _), names in GIVEN.items():
        listed = F.array(*[F.lit(n) for n in names.split()])
        gender = F.when(F.array_contains(listed, F.initcap("part")), g).otherwise(gender)
    for g, names in TITLES.items():
        if g != "n":
            listed = F.array(*[F.lit(t) for t in names.split()])
            gender = F.when(F.array_contains(listed, bare), g).otherwise(gender)
    given = (F.col("nth") == 0) | ((F.col("nth") == 1) & (F.col("parts") == 3))
    word = (
        F.when((F.col("nth") == 0) & titled, "keep")
        .when(given, F.concat(F.lit("given-"), gender, F.lit("-"), script))
        .otherwise(F.concat(F.lit("surname-"), script))
    )
    digits = F.expr(r"regexp_replace(part, '\\D', '')")
    valid = F.expr(f"({_sum_of_check('digits')}) % 10 = 0")
    df = df.withColumn("digits", F.when(F.col("kind") == "card", digits).otherwise("0"))
    card = F.when(valid & (F.length("digits") >= 13), "card").otherwise("keep")
    kind = (
        F.when(F.col("kind") == "person", word)
        .when(F.col("kind") == "card", card)
        .when(F.col("told") & (F.col("nth") == 0), "keep")
        .otherwise(F.col("kind"))
    )
    spaced = kind.isin("phone", "card", "ssn", "iban")
    form = F.when(spaced, F.expr(_alnum("part"))).otherwise(F.col("part"))
    gap = F.when(F.col("kind") == "person", " ").otherwise("").alias("gap")
    return df.select("mention", "nth", kind.alias("type"), "part", F.lower(form).alias("form"), gap)


def _drawn(entities: DataFrame, secret: str) -> DataFrame:
    """Add `surrogate`, what the key gives for (type, form) at this attempt, in lower case.

    Characters and hashes are arrays, so that a long form costs its length and no square.
    """
    seed = F.concat_ws("|", F.lit(secret), "type", "form", F.col("attempt").cast("string"))
    # Every hash reads the seed, so that of a long form is hashed first.
    seed = F.when(F.length("form") > 128, F.sha2(seed, 256)).otherwise(seed)
    df = entities.withColumn("seed", seed).withColumn("stem", F.expr(_alnum("form")))
    df = df.withColumn("chars", F.split("stem", ""))
    df = df.withColumn(
        "hashes",
        F.expr(
            "flatten(transform(array(seed), s -> transform(sequence(0, size(chars) div 32 + 1), "
            "b -> sha2(concat(s, '|', b), 256))))"
        ),
    )
    byte = "substr(get(hashes, cast((i - 1) div 32 as int)), (i - 1) % 32 * 2 + 1, 2)"
    at = f"cast(conv({byte}, 16, 10) as int)"
    hexadecimal = F.expr("type = 'secret' and form rlike '^[0-9a-f]+$'")
    alphabet = F.when(hexadecimal, "abcdef").otherwise("abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn("alphabet", alphabet)
    # Country codes, card brands and top-level domains stay.
    df = df.withColumn(
        "head",
        F.expr(
            "case type when 'phone' then greatest(length(stem) - 10, 0) when 'card' then 1 "
            "when 'iban' then 2 else 0 end"
        ),
    )
    domain = _alnum(r"regexp_extract(form, '\\.([^.]*)$', 1)")
    df = df.withColumn("tail", F.expr(f"if(type = 'email', length({domain}), 0)"))
    letter = f"substr(alphabet, {at} % length(alphabet) + 1, 1)"
    lead = "if(i = head + 1, 2, 0)"  # no leading zero
    filled = (
        "concat_ws('', zip_with(chars, sequence(1, size(chars)), (c, i) -> case "
        "when i <= head or i > size(chars) - tail then c "
        f"when c rlike '[0-9]' then cast({lead} + {at} % (10 - {lead}) as string) "
        f"when c rlike '[a-z]' then {letter} else c end))"
    )
    df = df.withColumn("filled", F.expr(filled))
    body = "substr(filled, 1, length(filled) - 1)"
    check = f"cast((10 - ({_sum_of_check(f'concat({body}, 0)')}) % 10) % 10 as string)"
    octets = "concat_ws('.', transform(sequence(1, 4), i -> cast(1 + " + at + " % 254 as string)))"
    surrogate = F.when(F.col("type") == "ip", F.expr(octets))
    surrogate = surrogate.when(F.col("type") == "card", F.expr(f"concat({body}, {check})"))
    # Names: one from the list at first, more of them joined when those are taken.
    for script in _SYLLABLES:
        for gender in "mfn":
            names = " ".join(v for (g, s), v in GIVEN.items() if s == script and gender in (g, "n"))
            n = len(names.split())
            pick = f"lower(element_at({_sql_array(names)}, {at} % {n} + 1))"
            joined = f"concat_ws('-', transform(sequence(1, attempt div 4 + 1), i -> {pick}))"
            surrogate = surrogate.when(F.col("type") == f"given-{gender}-{script}", F.expr(joined))
        pick = f"element_at({_sql_array(_SYLLABLES[script])}, {at} % 24 + 1)"
        joined = f"concat_ws('', transform(sequence(1, 3 + attempt div 4), i -> {pick}))"
        surrogate = surrogate.when(F.col("type") == f"surname-{script}", F.expr(joined))
    filled = F.expr(_spelled("form", "filled"))
    return df.select("type", "form", "attempt", surrogate.otherwise(filled).alias("surrogate"))


def _spelled(pattern: str, letters: str) -> str:
    """`pattern` with its letters and digits replaced, in order, by those of `letters`."""
    chars = f"transform(split({pattern}, ''), (c, i) -> named_struct('i', i, 'c', c))"
    other = r"not (x.c rlike '[\\p{L}\\p{N}]')"
    new = r"coalesce(if(x.c rlike '\\p{Lu}', upper(l), l), '')"
    # Each keeps its place; letters beyond the pattern's are left out.
    put = (
        f"zip_with(filter({chars}, x -> not ({other})), split({letters}, ''), (x, l) -> "
        f"named_struct('i', x.i, 'c', if(x.i is null, '', {new})))"
    )
    placed = f"sort_array(concat(filter({chars}, x -> {other}), {put}))"
    return f"concat_ws('', transform({placed}, x -> x.c))"


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """type, form, surrogate for the distinct entities (type, form), no two alike.

    A surrogate that equals an entity of the corpus is taken as shared with it.
    """
    taken = entities.select("type", F.col("form").alias("surrogate"), F.lit(True).alias("real"))
    current = stored(_drawn(entities.withColumn("attempt", F.lit(0)), secret), "surrogates")
    while True:
        holders = current.groupBy("type", "surrogate").agg(
            F.count("*").alias("n"), F.min(F.struct("attempt", "form")).alias("first")
        )
        clash = holders.join(taken, ["type", "surrogate"], "left").where("n > 1 or real")
        again = current.join(clash, ["type", "surrogate"]).where(
            F.col("real") | (F.col("form") != F.col("first.form"))
        )
        again = stored(
            again.select("type", "form", (F.col("attempt") + 1).alias("attempt")), "clashes"
        )
        if not again.take(1):
            return current.select("type", "form", "surrogate")
        # The one that keeps a shared surrogate is the one that has had it for fewest attempts.
        kept = current.join(again, ["type", "form"], "left_anti")
        current = stored(kept.union(_drawn(again, secret)), "surrogates")


def _replacements(mentions: DataFrame, secret: str) -> DataFrame:
    """mention -> replacement for every distinct mention that is personal data."""
    parts = stored(_typed(mentions.select("mention").distinct()), "mentions")
    entities = parts.where("type <> 'keep'").select("type", "form").distinct()
    found = parts.join(surrogates(entities, secret), ["type", "form"], "left")
    own = F.expr(_spelled("part", _alnum("surrogate")))
    shout = (F.upper("part") == F.col("part")) & (F.length("part") > 1)
    capital = F.regexp_replace(F.initcap(F.regexp_replace("surrogate", "-", " ")), " ", "-")
    named = F.when(shout, F.upper("surrogate")).otherwise(capital)
    text = (
        F.when(F.col("type") == "keep", F.col("part"))
        .when(F.col("type").rlike("^(given|surname)"), named)
        .when(F.col("type") == "ip", F.col("surrogate"))
        .otherwise(own)
    )
    words = F.sort_array(F.collect_list(F.struct("nth", text.alias("text"))))
    return found.groupBy("mention").agg(
        F.call_function(
            "array_join", F.transform(words, lambda w: w["text"]), F.first("gap")
        ).alias("replacement"),
        F.max(F.col("type") != "keep").alias("personal"),
    )


def replaced(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """`record` (all columns of `docs`, `text` with surrogates) and n_mentions.

    Null and empty texts stay as they are, with no mentions. Equal rows stay equal. The same
    entity has the same surrogate in all documents. An empty table gives no rows. Columns of
    `docs` are inside `record`, so their names cannot clash with others.
    """
    body = F.col(text)
    found = F.coalesce(body.rlike(PATTERN), F.lit(False))
    plain = docs.where(~found).select(packed(docs), F.lit(0).cast("long").alias("n_mentions"))
    touched = docs.where(found).select(
        packed(docs),
        F.monotonically_increasing_id().alias("_at"),
        mentions_of(body).alias("_mentions"),
        F.split(body, PATTERN, -1).alias("_between"),
    )
    touched = stored(touched, "documents-with-mentions")
    mentions = touched.select("_at", F.posexplode("_mentions").alias("nth", "mention"))
    table = stored(_replacements(mentions, secret), "replacements")
    new = mentions.join(table, "mention").groupBy("_at").agg(
        F.sort_array(F.collect_list(F.struct("nth", "replacement"))).alias("_new"),
        F.count(F.when(F.col("personal"), 1)).alias("n_mentions"),
    )
    whole = F.concat_ws(
        "",
        F.transform(
            F.col("_between"),
            lambda x, i: F.concat(x, F.coalesce(F.get("_new", i)["replacement"], F.lit(""))),
        ),
    )
    same = {c: F.col(f"record.`{c}`") for c in docs.columns}
    fields = [column.alias(c) for c, column in (same | {text: whole}).items()]
    changed = touched.join(new, "_at").select(F.struct(*fields).alias("record"), "n_mentions")
    return plain.union(changed)
