"""Personal data: detected entities are replaced by keyed surrogates of the same kind.

An entity is named by its kind and a canonical value (addresses without case, phone numbers without
country code, and so on), so that its spellings corefer. Its surrogate is drawn from a keyed hash of
that name and then written in the spelling at hand: digits stay digits, capitals stay capitals,
Cyrillic stays Cyrillic, a lady stays a lady. A family name has one surrogate wherever it stands, a
given name one for each whole name, so `Mrs. Anna Schmidt`, `Anna Schmidt`, `Mr. Schmidt` and
`Schmidt` stay related. All surrogates of the corpus are checked against each other and against all
real values; an entity that loses such a clash draws again.

Detected: e-mail; persons after a form of address, and then each further mention of the whole or the
family name (three letters or more) in the same text; access keys with a known prefix; hexadecimal
secrets of 32 to 64 digits; IBAN; IPv6 and IPv4; cards of 16 digits in fours or of 15 in 4-6-5;
numbers in 3-2-4; phones with a country code, in 3-3-4, or with a leading 0 in common groupings. Not
detected: persons that no text addresses, a given name alone, phones of seven digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import with_text
from tessella.session import cut

#: Production parameters: overrides that become a literal, and rounds of drawing again.
LITERAL_OVERRIDES, ROUNDS = 500, 60
#: The setting that holds the secret, and what stands in for it where nobody set one, as in tests.
KEY_SETTING, UNSET_KEY = "spark.tessella.pii.key", "no-secret-set"

#: Forms of address by gender, n for either.
MALE = "Mr Mister Sir Herr Monsieur Señor Господин".split()
FEMALE = "Mrs Ms Miss Frau Madame Mme Señora Señorita Госпожа".split()
EITHER = "Dr Prof Professor Доктор".split()
#: Given names by gender and script, and syllables of family names by script.
GIVEN = {
    "mL": "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul".split(),
    "fL": "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    "nL": "Alex Andrea Bo Chris Dominique Jamie Jean Jo Kim Kit Lou Noel Robin Sam Sascha Toni".split(),
    "mC": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Степан".split(),
    "fC": "Анна Берта Вера Галина Дарья Ева Зоя Ирина Клара Лариса Мария Нина Ольга Полина Раиса Софья".split(),
    "nC": "Валя Веня Витя Геня Женя Лёля Люся Мика Паша Саша Слава Стася Тоша Феля Шура Юля".split(),
}
SYLLABLES = {"L": "ba de fi go hu ka le mi no pu ra se ti vo wa zu".split(), "C": "ба де фи го ху ка ле ми но пу ра се ти во га зу".split()}

#: How access keys of common services begin, and country codes of one and two digits.
KEY_PREFIX = r"(?:A[KS]IA|AIza|gh[pousr]_|sk-|xox[abp]-)"
COUNTRY = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

_NAME = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{Lu}[\p{L}\p{M}]*+)*+"
_ADDRESS = rf"(?:{'|'.join(MALE + FEMALE + EITHER)})\.? "
#: What stands before a name: the form of address and initials, which go.
TITLE = rf"^{_ADDRESS}(?:\p{{Lu}}\. ?)*"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: One branch a kind; each can only begin where its run of characters begins, so matching is linear.
KINDS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)+",
    "person": rf"(?<!\p{{L}}){_ADDRESS}(?:\p{{Lu}}\. ?)*{_NAME}(?: {_NAME})?",
    "key": rf"(?<![0-9A-Za-z]){KEY_PREFIX}[0-9A-Za-z_-]{{16,200}}+(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:(?=[a-f]{0,64}[0-9])[0-9a-f]{32,64}|(?=[A-F]{0,64}[0-9])[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[0-9]{1,3})?(?![0-9A-Za-z])",
    "ip6": r"(?<![0-9A-Za-z:])(?=[A-Fa-f:]{0,40}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[1-9](?:[ .()/-]{0,2}[0-9]){7,14}(?![0-9])"
    r"|(?<![0-9.,-])0(?:[0-9]{9,10}|[0-9]{2,4}[ /-][0-9]{5,8}|[0-9](?:[ .-][0-9]{2}){4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: No entity without one of these.
HINT = "[0-9@]|(?:" + "|".join(MALE + FEMALE + EITHER) + r")\.? \p{Lu}|" + KEY_PREFIX


def _sql(text: str) -> str:
    """A SQL literal that is read as it stands."""
    if "'" in text and '"' not in text:
        return 'r"' + text + '"'
    return "r'" + text.replace("'", "\\'") + "'"


def find(df: DataFrame) -> DataFrame:
    """Add to `df` with a text `t`: `names`, a pattern of the persons addressed in it, null if none, and
    `w`, the entities in order as they are written, empty for a null text."""
    static = F.when(F.col("t").rlike(HINT), F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("w", F.coalesce(static, F.array().cast("array<string>")))
    df = df.withColumn("addressed", F.expr(f"filter(w, e -> e rlike {_sql(TITLE)} and e not like '%@%')"))
    df = df.withColumn("whole", F.expr(f"array_distinct(transform(addressed, e -> regexp_replace(e, {_sql(TITLE)}, '')))"))
    df = df.withColumn("whole", F.expr("array_distinct(concat(whole, transform(whole, n -> substring_index(n, ' ', -1))))"))
    df = df.withColumn("whole", F.expr("transform(array_sort(transform(filter(whole, n -> length(n) > 2), n -> struct(-length(n) as size, n as n))), s -> s.n)"))
    df = df.withColumn("names", F.when(F.size("whole") > 0, F.concat(F.lit(r"|(?<!\p{L})(?=\p{Lu})(?:"), F.array_join("whole", "|"), F.lit(r")(?!\p{L})"))))
    again = F.regexp_extract_all("t", F.concat(F.lit(PATTERN), F.col("names")), F.lit(0))
    return df.withColumn("w", F.when(F.col("names").isNotNull(), again).otherwise(F.col("w"))).drop("whole")


def parse(df: DataFrame) -> DataFrame:
    """Add `es`, an array of (e, kind, canon), for the entities `w`; `addressed` goes."""
    bare = lambda e: f"regexp_replace({e}, {_sql(TITLE)}, '')"
    tests = (("email", "@"), ("key", "^" + KEY_PREFIX), ("secret", "^[0-9A-Fa-f]{32,64}$"), ("iban", "^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"), ("ip6", ":"))
    numbers = (("card", f"^(?:{KINDS['card']})$"), ("ip", r"^[0-9]+(?:\.[0-9]+){3}$"), ("ssn", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))
    when = lambda pairs: " ".join(f"when e rlike {_sql(test)} then '{name}'" for name, test in pairs)
    kind = rf"case {when(tests)} when e rlike r'\p{{L}}' then case when {bare('e')} like '% %' then 'person' else 'family' end {when(numbers)} else 'phone' end"
    digits = "regexp_replace(s.e, '[^0-9]', '')"
    gender = lambda e: f"case when {e} rlike {_sql('^(?:' + '|'.join(FEMALE) + ')[. ]')} then 'f' when {e} rlike {_sql('^(?:' + '|'.join(EITHER) + ')[. ]')} then 'n' else 'm' end"
    script = lambda e: rf"case when {bare(e)} rlike r'\p{{IsCyrillic}}' then 'C' else 'L' end"
    person = lambda e: f"concat({gender(e)}, {script(e)}, ' ', lower({bare(e)}))"
    phone = f"right(case when s.e like '+%' then regexp_replace({digits}, '^{COUNTRY}', '') else {digits} end, 10)"
    df = df.withColumn("known", F.expr(f"array_sort(transform(addressed, e -> {person('e')}))"))
    of_known = f"coalesce(get(filter(s.known, k -> substring(k, 4) = lower({bare('s.e')}) and not s.e rlike {_sql(TITLE)}), 0), {person('s.e')})"
    canon = f"case s.kind when 'email' then lower(s.e) when 'secret' then lower(s.e) when 'ip6' then lower(s.e) when 'ip' then s.e when 'key' then s.e when 'iban' then replace(s.e, ' ', '') when 'phone' then {phone} when 'family' then concat({script('s.e')}, ' ', lower({bare('s.e')})) when 'person' then {of_known} else {digits} end"
    df = df.withColumn("es", F.expr(f"zip_with(w, array_repeat(known, size(w)), (e, known) -> struct(e as e, {kind} as kind, known as known))"))
    return df.withColumn("es", F.expr(f"transform(es, s -> struct(s.e as e, s.kind as kind, {canon} as canon))")).drop("known", "addressed")


def _stand_ins(canon: str, turn, key: str) -> dict[str, str]:
    """SQL by kind for the surrogate of `canon`, drawn in the turn that `turn` gives for the kind."""

    def bound(kind: str, body: str) -> str:
        """`body` with the hash of the entity as h: drawn once, not for each character."""
        t = turn(kind)
        hashes = f"named_struct('t', {t}, 'seed', sha2(concat_ws('|', {_sql(key)}, '{kind}', {canon}, {t}), 256), 'more', sha2(concat_ws('|', {_sql(key)}, {t}, {canon}, '{kind}'), 256))"
        spelt = "named_struct('t', g.t, 'seed', g.seed, 'digits', translate(g.seed, 'abcdef', '012345'), 'letters', translate(concat(g.seed, g.more), '0123456789abcdef', 'bcdfgaeioulmnprs'), 'cyrillic', translate(concat(g.seed, g.more), '0123456789abcdef', 'бвгдзаеиоулмнпрс'))"
        return f"get(transform(transform(array({hashes}), g -> {spelt}), h -> {body}), 0)"

    t, seed, digits, letters, cyrillic = (f"h.{name}" for name in ("t", "seed", "digits", "letters", "cyrillic"))

    def pick(values: list[str], seed: str, at: int) -> str:
        return f"element_at(array({', '.join(_sql(v) for v in values)}), cast(conv(substring({seed}, {at}, 1), 16, 10) as int) + 1)"

    def by_class(arms: str, start: str = "0") -> str:
        return f"array_join(transform(split({canon}, ''), (c, i) -> case when i < {start} then c {arms} else c end), '')"

    out = {}
    # All but the last label of the domain is redrawn, character by character and class by class.
    classes = rf"when c rlike '[0-9]' then substring({digits}, i % 64 + 1, 1) when c rlike r'\p{{IsCyrillic}}' then substring({cyrillic}, i % 128 + 1, 1) when c rlike r'\p{{L}}' then substring({letters}, i % 128 + 1, 1)"
    but_last = f"array_join(transform(split(left({canon}, length({canon}) - length(substring_index({canon}, '.', -1))), ''), (c, i) -> case {classes} else c end), '')"
    out["email"] = f"concat(substring({letters}, 40, greatest(0, {t} - 8)), {but_last}, substring_index({canon}, '.', -1))"
    start = f"length(regexp_extract({canon}, '^{KEY_PREFIX}', 0))"
    out["key"] = by_class(f"when c rlike '[0-9]' then substring({digits}, i % 64 + 1, 1) when c rlike '[a-z]' then substring({letters}, i % 128 + 1, 1) when c rlike '[A-Z]' then upper(substring({letters}, i % 128 + 1, 1))", start)
    out["secret"] = f"substring({seed}, 1, length({canon}))"
    out["ip6"] = by_class(f"when c rlike '[0-9a-f]' then substring({seed}, i % 64 + 1, 1)")
    out["ip"] = "concat(" + " , '.', ".join(f"cast(conv(substring({seed}, {2 * k + 1}, 2), 16, 10) as int) % 254 + 1" for k in range(4)) + ")"
    # The country stays; the two check digits make the whole 1 modulo 97 with letters read as 10 to 35.
    classes = f"when c rlike '[0-9]' then substring({digits}, i % 64 + 1, 1) when c rlike '[A-Z]' then upper(substring({letters}, i % 128 + 1, 1))"
    body = f"substring({by_class(classes)}, 5)"
    moved = f"split(concat({body}, substring({canon}, 1, 2), '00'), '')"
    rest = f"aggregate({moved}, 0, (a, c) -> case when c rlike '[A-Z]' then (a * 100 + ascii(c) - 55) % 97 when c rlike '[0-9]' then (a * 10 + cast(c as int)) % 97 else a end)"
    out["iban"] = f"concat(substring({canon}, 1, 2), lpad(cast(98 - {rest} as string), 2, '0'), {body})"
    # The last digit is right by the check sum where that of the card is, else wrong.
    weight = "aggregate(sequence(1, length({c}) - 1), 0, (a, i) -> a + case when (length({c}) - i) % 2 = 1 then cast(substring({d}, i, 1) as int) * 2 - case when cast(substring({d}, i, 1) as int) > 4 then 9 else 0 end else cast(substring({d}, i, 1) as int) end)"
    check = lambda d: f"((10 - {weight.format(d=d, c=canon)} % 10) % 10)"
    last = f"case when {check(canon)} = cast(right({canon}, 1) as int) then {check(digits)} else ({check(digits)} + 1 + cast(substring({digits}, 20, 1) as int) % 9) % 10 end"
    out["card"] = f"concat(substring({digits}, 1, length({canon}) - 1), {last})"
    for kind in ("ssn", "phone"):
        out[kind] = f"substring({digits}, 1, length({canon}))"
    # `canon` of a family is script and name, of a whole name gender and script, given and family name.
    arms = " ".join(f"when '{script}' then initcap(concat({', '.join(pick(parts, seed, at) for at in range(1, 7))}, repeat({pick(parts, seed, 8)}, greatest(0, {t} - 8))))" for script, parts in SYLLABLES.items())
    out["family"] = f"case left({canon}, 1) {arms} end"
    # Sixteen names are soon used up in a large family: later turns add syllables.
    more = lambda script, k: f"case when {t} > {k} then {pick(SYLLABLES[script], seed, 8 + k)} else '' end"
    tail = lambda script: f"concat({', '.join(more(script, k) for k in range(2, 9))})"
    arms = " ".join(f"when '{group}' then concat({pick(names, seed, 64)}, {tail(group[1])})" for group, names in GIVEN.items())
    out["given"] = f"case left({canon}, 2) {arms} end"
    return {kind: bound(kind, body) for kind, body in out.items()}


def _case(kind: str, arms: dict[str, str]) -> str:
    return f"case {kind} " + " ".join(f"when '{k}' then {sql}" for k, sql in arms.items()) + " end"


def _written(raw: str, value: str) -> dict[str, str]:
    """SQL by kind that writes a surrogate in the spelling of the entity it replaces."""
    left = f"length(regexp_replace(substring({raw}, i + 1), '[^0-9]', ''))"
    numbers = f"array_join(transform(split({raw}, ''), (c, i) -> case when c rlike '[0-9]' and {left} <= length({value}) then substring({value}, length({value}) + 1 - {left}, 1) else c end), '')"
    email = f"case when length({value}) <> length({raw}) then {value} else array_join(transform(split({raw}, ''), (c, i) -> case when c <> lower(c) then upper(substring({value}, i + 1, 1)) else substring({value}, i + 1, 1) end), '') end"
    capitals = f"case when {raw} = upper({raw}) then upper({value}) else {value} end"
    iban = f"array_join(transform(split({raw}, ''), (c, i) -> case when c = ' ' then c else substring({value}, length(replace(substring({raw}, 1, i + 1), ' ', '')), 1) end), '')"
    title, bare = f"regexp_extract({raw}, {_sql('^' + _ADDRESS)}, 0)", f"regexp_replace({raw}, {_sql(TITLE)}, '')"
    name = f"concat({title}, case when {bare} = upper({bare}) and length({bare}) > 1 then upper({value}) else {value} end)"
    return {"email": email, "secret": capitals, "ip6": capitals, "ip": value, "key": value, "iban": iban, "card": numbers, "ssn": numbers, "phone": numbers, "family": name, "person": name}


def resolve(found: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, turn, value) for distinct entities (kind, canon): surrogates that clash with nothing.

    A surrogate may be no other entity's and no real value of its kind; a given name must differ from
    the real one and from the others of the same family name, whose surrogate is no real name. In
    each round the losers of a clash draw again, while the earliest keeps what it has; values once
    settled are never given up. Clashes are rare, so a round moves few rows after the first.
    """
    drawn = lambda df: df.withColumn("value", F.expr(_case("kind", _stand_ins("canon", lambda kind: "turn", key))))
    real = found.where("kind <> 'given'").select("kind", F.expr("lower(case kind when 'family' then substring(canon, 3) else canon end)").alias("meant"))
    meant = F.expr("lower(case kind when 'given' then concat(substring_index(canon, ' ', -1), ' ', value) else value end)")
    state = cut(drawn(found.select("kind", "canon").withColumn("turn", F.lit(0))).withColumn("meant", meant))
    for _ in range(rounds):
        real_hit = state.join(real, ["kind", "meant"], "left_semi").select("kind", "canon")
        itself = state.where("kind = 'given' and lower(value) = substring_index(substring(canon, 4), ' ', 1)").select("kind", "canon")
        clash = state.groupBy("kind", "meant").agg(F.min(F.struct("turn", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = state.join(clash, ["kind", "meant"]).where("struct(turn, canon) <> first").select("kind", "canon")
        losers = cut(real_hit.unionByName(twice).unionByName(itself).distinct())
        if losers.isEmpty():
            return state.drop("meant")
        again = drawn(state.join(losers, ["kind", "canon"], "left_semi").select("kind", "canon", (F.col("turn") + 1).alias("turn"))).withColumn("meant", meant)
        state = cut(state.join(losers, ["kind", "canon"], "left_anti").unionByName(again))
    raise RuntimeError(f"surrogates still clash after {rounds} rounds: their space is too small")


def pseudonymise(docs: DataFrame, key: str, literal_overrides: int = LITERAL_OVERRIDES) -> DataFrame:
    """The rows of `docs`, all columns, with surrogates in `text`, plus the long column `n_entities`.

    Equal entities get equal surrogates in the whole table and different ones different surrogates
    under the secret `key`. Null texts stay null with 0 entities; empty texts and texts without
    entities stay as they are, byte for byte; repeated rows and rows with a null id are each replaced
    alike; an empty table stays empty; a column named n_entities is replaced. A text is searched once
    and written to the checkpoint folder with its entities. Only the entities that had to draw again
    travel: as a literal up to `literal_overrides` of them, else joined by row number to the rows
    that hold any entity; all other texts stay where they are. A text that addresses very many
    persons by name is matched against each of the names.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    found = parse(find(docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("t"))))
    rows = cut(found.select("row", F.when(F.size("w") > 0, F.col("es")).alias("es"), "names", F.monotonically_increasing_id().alias("rid")))
    held = rows.where("es is not null").select("rid", F.explode("es").alias("x")).select("rid", "x.kind", "x.canon")
    # A whole name is drawn in two parts.
    parts = F.expr("case kind when 'person' then array(struct('given' as kind, canon as canon), struct('family' as kind, concat(substring(canon, 2, 1), ' ', substring_index(canon, ' ', -1)) as canon)) else array(struct(kind as kind, canon as canon)) end")
    held = held.select("rid", F.explode(parts).alias("x")).select("rid", "x.kind", "x.canon")
    settled = resolve(cut(held.select("kind", "canon").distinct()), key)
    redrawn = settled.where("turn > 0").select(F.concat_ws(":", "kind", "canon").alias("name"), "turn")
    few = redrawn.limit(literal_overrides + 1).collect()
    none = F.lit(None).cast("map<string,int>")
    if not few:
        rows = rows.withColumn("turns", none)
    elif len(few) <= literal_overrides:
        rows = rows.withColumn("turns", F.expr("map(" + ", ".join(f"{_sql(r['name'])}, {r['turn']}" for r in few) + ")"))
    else:
        named = held.select("rid", F.concat_ws(":", "kind", "canon").alias("name")).distinct().join(redrawn, "name")
        turns = named.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("name", "turn"))).alias("turns"))
        rows = rows.where("es is not null").join(turns, "rid", "left").select(*rows.columns, "turns").unionByName(rows.where("es is null").withColumn("turns", none))
    turn = lambda canon: lambda kind: f"coalesce(try_element_at(turns, concat('{kind}:', {canon})), 0)"
    family = "concat(substring(x.canon, 2, 1), ' ', substring_index(x.canon, ' ', -1))"
    arms = _stand_ins("x.canon", turn("x.canon"), key)
    arms["person"] = f"concat({arms.pop('given')}, ' ', {_stand_ins(family, turn(family), key)['family']})"
    written = f"transform(transform(es, x -> struct(x.e as e, x.kind as kind, {_case('x.kind', arms)} as value)), y -> {_case('y.kind', _written('y.e', 'y.value'))})"
    pattern = F.concat(F.lit(PATTERN), F.coalesce("names", F.lit("")))
    texts = F.col("row.text").cast("string")
    ready = rows.withColumn("ys", F.when(F.col("es").isNotNull(), F.expr(written))).withColumn("gaps", F.when(F.col("es").isNotNull(), F.split(texts, pattern, -1)))
    joined = F.when(F.col("es").isNotNull(), F.expr("array_join(zip_with(gaps, ys, (g, y) -> concat(g, coalesce(y, ''))), '')")).otherwise(texts)
    flat = ready.select("row", joined.alias("__new"), F.when(F.col("es").isNotNull(), F.size("es")).otherwise(0).cast("long").alias("__n"))
    out = with_text(flat.select(*[F.col("row").getField(c).alias(c) for c in names], "__new", "__n"), F.col("__new"))
    return out.withColumn("n_entities", F.col("__n")).drop("__new", "__n")


def session_key(spark: SparkSession) -> str:
    """The secret that the session holds."""
    return spark.conf.get(KEY_SETTING, UNSET_KEY)


def query(docs: DataFrame) -> DataFrame:
    """op8: every document's text with surrogates under the session's secret."""
    return pseudonymise(docs, session_key(docs.sparkSession)).select("doc_id", "text", "n_entities")
