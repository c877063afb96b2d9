"""Operator: variant spellings of names typed by people.

Merge-and-rematch resolution. Each spelling is read as a form - a full name, a surname with an initial, a nickname or a
shortened name with a surname, a login handle, or an organisation - with a canonical key; equal keys, and keys that differ
in how umlauts are written, are one entity. A merged entity carries the union of its members' names and initials, and with
this richer profile re-enters blocking in the next round: names within one typing error of each other in one part, or in
both if they are long, are merged, and a form that leaves several people possible (an initial, a nickname of several names,
a shortened name, a handle) joins an entity when exactly one fits. Rounds go on until nothing merges any more; from the second
round on only names that the merges have brought are compared anew.

Typing errors don't make chains: a name joins the most used of the names within one error, and only if all names within one
error of it are within one error of that one too, so that Martin, Marton, Barton and Burton stay four people.

Blocks are small by construction: a block key holds one exact part of a name and one part with at most one letter left
out, or both parts so, never a first name or a surname alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.runtime import cut

#: Short forms of given names (fixed values): formal name, then its short forms.
SHORT_FORMS = """
alexander alex sasha sandro lex xander alec / alexandra alex sasha sandra / andrew andy drew / anneliese anne anni liesel / anthony tony / antonio toni tonio / barbara barb babs / benjamin ben benny benji / catherine cathy kate cat
charles charlie chuck / christine chris tina / christopher chris kit topher / daniel dan danny / david dave davy / deborah deb debbie / dorothy dot dolly / edward ed eddie ted ned / elizabeth beth betty liz lizzie eliza libby lisa
eugene gene / florence flo / francisco paco fran pancho curro / frances fran fanny / franziska fran franzi / frederic fred freddy fredi / frederick fred freddy / gabriele gabi / gabriel gabe / george georgie / gerald gerry / gregory greg
harold harry hal / henry harry hank / ignacio nacho / isabella bella isa / jacob jake / james jim jimmy jamie / jennifer jen jenny jenn / joanna jo / johannes hannes jo hans / john jack johnny / jonathan jon / joseph joe joey jo / josephine jo josie
jose pepe / katherine kate kathy katie kat kitty kay / kenneth ken kenny / lawrence larry / leandro leo / leonard leo len lenny / leopold leo / louis lou louie / ludwig lutz / manuel manolo manu / margaret maggie peggy meg marge greta / martin marty / mary molly polly
matthew matt matty / matthias matti matze hias / maximilian max / michael mike mick micky mickey mikey / miguel migue / mikhail misha / nathaniel nate nat / nicholas nick nicky nico / nikolai nik kolya niko / ottilie tilly otti / patricia pat patty tricia / patrick pat paddy
peter pete / philip phil / rebecca becky / richard rick dick rich ricky / robert bob bobby rob robby robbie bert / ronald ron ronnie / rudolf rudi / samantha sam sammy / samuel sam sammy / sebastian seb basti / stephen steve / steven steve / susanne sue susi sanne / susan sue susie
teresa tess terry / theodore theo ted teddy / thomas tom tommy / timothy tim timmy / tomasz tomek / ulrich uli / victoria vicky tori vic / vincent vince / walter walt / wilhelm willi / william bill billy will willy liam / wolfgang wolfi / zachary zach
"""
#: Spellings of the kinds of organisation (fixed values): kind, then its spellings.
ORG_WORDS = "technologies technologies technology tech technolgies / software software sw / systems systems system sys / laboratories laboratories laboratory labs lab / foundation foundation fdn fndn / bot bot buildbot / institute institute inst / university university univ / solutions solutions / group group grp / team team / services services svcs"
#: Legal forms and fillers that say nothing (fixed values).
LEGAL = frozenset("inc llc ltd gmbh ag sa sarl co corp corporation company limited plc bv kg the build".split())
TITLES = frozenset("dr prof mr mrs ms mx sir ing phd md jr sr".split())

_FORMALS: dict[str, tuple[str, ...]] = {}
for _line in SHORT_FORMS.replace("\n", " / ").split(" / "):
    for _short in _line.split()[1:]:
        _FORMALS[_short] = (*_FORMALS.get(_short, ()), _line.split()[0])
_GIVEN = frozenset([*_FORMALS, *(f for fs in _FORMALS.values() for f in fs)])
_KINDS = {w: part.split()[0] for part in ORG_WORDS.split(" / ") for w in part.split()[1:]}
_PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ı": "i", "þ": "th", "ð": "d"})


def plain(text: str) -> str:
    """Without accents, special letters spelt out."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_PLAIN)) if not unicodedata.combining(c))


def _kind(word: str) -> str | None:
    if word in _KINDS:
        return _KINDS[word]
    if len(word) >= 7:
        for full in {k for k in _KINDS if len(k) >= 7}:
            if abs(len(full) - len(word)) <= 1 and _near(word, full):
                return _KINDS[full]
    return None


def _near(a: str, b: str) -> bool:
    """At most one letter left out, put in, changed or swapped with its neighbour."""
    if a == b:
        return True
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def read_form(spelling: str) -> tuple[str, str, str] | None:
    """(kind, x, y): full (two words, in order of the alphabet), init (initial, word), nick (short form of several names, word),
    short (first letters before a full stop, word), handle (letters, ''), org (name, kind); None for blanks."""
    text = re.sub(r"\([^)]*\)|<[^>]*>", " ", plain(spelling))
    text = re.sub(r"(?i)\bg\.\s*m\.\s*b\.\s*h\b\.?", "gmbh", text).replace("[bot]", " bot ")
    words = [w for w in re.split(r"[\s,_.;:/+]+", text) if w.strip("-'")]
    if len(words) == 1 and (m := re.fullmatch(r"([A-Z][a-z]+)([A-Z][a-z]+(?:-[A-Z][a-z]+)*)", words[0])):
        words = [m.group(1), m.group(2)]
    low = [w.lower().strip("-'") for w in words]
    low = [x for w in low for x in (w.split("-") if w.split("-")[-1] in _KINDS and w.count("-") == 1 else [w])]
    kinds = [k for w in low[1:] if (k := _kind(w))]
    if kinds:
        core = [w for w in low if w not in LEGAL and not _kind(w)]
        if core:
            return ("org", "".join(core), kinds[-1])
    if len(low) > 1 and any(w in LEGAL - {"co", "the", "build"} for w in low[1:]):
        core = [w for w in low if w not in LEGAL]
        if core:
            return ("org", "".join(core), "")
    while len(low) > 1 and low[0] in TITLES:
        low = low[1:]
    while len(low) > 2 and low[-1] in TITLES:
        low = low[:-1]
    full, initials = [w for w in low if len(w) > 1], [w for w in low if len(w) == 1]
    if not full:
        return ("handle", "".join(low), "") if low else None
    if len(full) == 1:
        return ("init", initials[0], full[0]) if initials else ("handle", full[0].replace("-", ""), "")
    x, y = full[0], full[-1]
    for a, b in ((x, y), (y, x)):
        if len(a) > 1 and a not in _FORMALS and a not in TITLES and re.search(rf"(?i)(?<![^\W_]){re.escape(a)}\.(?=[\s,]|$)", text):
            return ("short", a, b)
    for a, b in ((x, y), (y, x)):
        formals = _FORMALS.get(a, ())
        if len(formals) > 1:
            return ("nick", a, b)
    x, y = (_FORMALS[w][0] if w in _FORMALS else w for w in (x, y))
    return ("full", *sorted((x, y)))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(s, n, *f, raw_initials(s), "".join("xy"[i] for i in (0, 1) if f[i + 1] in _GIVEN)) for s, n in zip(b.column("spelling").to_pylist(), b.column("n").to_pylist()) if (f := read_form(s))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 1 else pa.string()) for i in range(7)], names=["spelling", "n", "kind", "x", "y", "initials", "given"])


def raw_initials(spelling: str) -> str:
    """First letters of all words as typed: Bob lends its b to an entity whose name is Robert."""
    return "".join(sorted({w[0].lower() for w in re.split(r"[\s,_.;:/+()]+", plain(spelling)) if w and w[0].isalpha()}))


def _smooth(c: str) -> Column:
    """Umlauts written with an e as those without: juergen is jurgen."""
    return F.regexp_replace(c, "([aou])e", "$1")


def _variants(c: str) -> Column:
    """The word and, if it is long enough for typing errors to be told from other names, the word with each letter left out."""
    s = F.col(c)
    cut_out = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.array_distinct(F.when(F.length(s) >= 4, F.concat(F.array(s), cut_out)).otherwise(F.array(s)))


def _one_error(a: Column, b: Column) -> Column:
    """One letter left out, put in or changed, or two swapped."""
    d = F.levenshtein(a, b)
    return (d <= 1) | ((d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))))


#: Letters of each part from which a name may have an error in both.
BOTH = 6
#: How many times as often a name must be used as a misspelling of it that has other neighbours too.
OFTEN = 3


def _near_names(names: DataFrame, new: DataFrame | None) -> DataFrame:
    """(a, b): entities, both ways round, of which two names (entity, kind, x, y, given) are within one error in one part, or in each of two
    long ones. Two known given names are never errors of each other. Pairs without a name of new are left out, if it is given."""
    full, org = names.where("kind = 'full'"), names.where("kind = 'org'")
    gx, gy = F.contains("given", F.lit("x")), F.contains("given", F.lit("y"))
    part = lambda df, tag, fixed, free, g: df.select("entity", F.concat_ws("|", F.lit(tag), fixed).alias("key"), F.explode(_variants(free)).alias("v"), F.col(free).alias("free"), g.alias("g"), F.lit("").alias("free2"), F.lit(False).alias("h"))
    one = part(full, "f", "x", "y", gy).union(part(full, "f", "y", "x", gx)).union(part(org, "o", "y", "x", F.lit(False)))
    long = full.where((F.length("x") >= BOTH) & (F.length("y") >= BOTH)).select("entity", "x", "y", gx.alias("g"), gy.alias("h"), F.explode(_variants("x")).alias("key"))
    long = long.select("entity", F.concat_ws("|", F.lit("b"), "key").alias("key"), F.explode(_variants("y")).alias("v"), F.col("x").alias("free"), "g", F.col("y").alias("free2"), "h")
    blocks = one.union(long)
    asked = blocks if new is None else blocks.join(new, "entity", "left_semi")
    other = blocks.select(F.col("entity").alias("e2"), "key", "v", F.col("free").alias("f2"), F.col("g").alias("fg"), F.col("free2").alias("g2"), F.col("h").alias("gh"))
    close = asked.join(other, ["key", "v"]).where("entity <> e2").where(_one_error(F.col("free"), F.col("f2")) & _one_error(F.col("free2"), F.col("g2")))
    close = close.where("NOT (free <> f2 AND g AND fg) AND NOT (free2 <> g2 AND h AND gh)")
    close = close.select(F.col("entity").alias("a"), F.col("e2").alias("b"))
    return close.distinct() if new is None else close.union(close.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _stars(near: DataFrame, used: DataFrame) -> DataFrame:
    """(own, target): entities that join the most used of those near them.

    near has (a, b) both ways round; used (entity, n). An entity joins its target if the target is itself the most used of its own
    neighbours, and all neighbours of the entity are the target's too. Where another neighbour of the target fails in
    this, the target must be used OFTEN times as often.
    """
    n = used.select(F.col("entity").alias("b"), "n")
    top = near.join(n, "b").groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("m"))).alias("top")).join(used.select(F.col("entity").alias("a"), "n"), "a")
    top = top.select("a", "n", F.col("top.n").alias("tn"), (-F.col("top.m")).alias("t")).withColumn("below", (F.col("n") < F.col("tn")) | ((F.col("n") == F.col("tn")) & (F.col("a") > F.col("t"))))
    top = cut(top)
    heads = top.where("NOT below").select(F.col("a").alias("t"))
    open_ = top.where("below").join(heads, "t", "left_semi")
    # neighbours of an entity that its target lacks
    far = near.join(open_.select("a", "t"), "a").where("b <> t").join(near.select(F.col("a").alias("t"), "b"), ["t", "b"], "left_anti").select("a").distinct()
    fits = open_.join(far, "a", "left_anti")
    loose = near.join(heads, near.a == heads.t, "left_semi").select(F.col("a").alias("t"), F.col("b").alias("a")).join(fits.select("a", "t"), ["a", "t"], "left_anti").select("t").distinct().withColumn("loose", F.lit(1))
    return fits.join(loose, "t", "left").where(F.col("loose").isNull() | (F.col("tn") >= OFTEN * F.col("n"))).select(F.col("a").alias("own"), F.col("t").alias("target"))


def _full_names(mine: DataFrame) -> DataFrame:
    """(entity, kind, x, y, given): the names of each entity and which parts are known given names: those of its full and org members, and of its nicknames with each formal name that a
    full member has."""
    whole = mine.where("kind IN ('full', 'org')").select("entity", "kind", "x", "y", "given")
    nicks = mine.where("kind = 'nick'").select("entity", F.explode(F.split(F.element_at(_formals(), F.col("x")), r"\|")).alias("g"), F.col("y").alias("w"))
    given = whole.where("kind = 'full'").select("entity", F.explode(F.array("x", "y")).alias("g")).distinct()
    more = nicks.join(given, ["entity", "g"]).select("entity", F.lit("full").alias("kind"), F.least("g", "w").alias("x"), F.greatest("g", "w").alias("y"), F.when(F.col("g") < F.col("w"), "x").otherwise("y").alias("given"))
    return whole.union(more).groupBy("entity", "kind", "x", "y").agg(F.max("given").alias("given"))


def _formals() -> Column:
    """Map of the short forms of several names to these, with bars between."""
    return F.create_map(*[F.lit(x) for s, fs in sorted(_FORMALS.items()) if len(fs) > 1 for x in (s, "|".join(fs))])


def _profiles(mine: DataFrame) -> DataFrame:
    """(entity, named, how, part, w): what an entity can be called, by the union of its members' names and initials.

    how i: an initial and a word; n: a given name and a word, both ways round; s: the first two letters of a given name and a word, with the name in
    part's place told by full; h: the letters of a login handle.
    """
    full = F.col("kind") == "full"
    both = F.array(F.struct(F.col("x").alias("g"), F.col("y").alias("w")), F.struct(F.col("y").alias("g"), F.col("x").alias("w")))
    sides = mine.where("kind NOT IN ('org', 'handle')").select("entity", "named", "kind", "union", F.explode(F.when(full, both).otherwise(F.slice(both, 1, 1))).alias("s"))
    sides = sides.select("entity", "named", "kind", "union", "s.g", "s.w")
    letters = F.when(full, F.array_distinct(F.concat(F.array(F.substring("g", 1, 1)), F.filter("union", lambda i: (i != "") & (i != F.substring("w", 1, 1)))))).otherwise(F.array(F.substring("g", 1, 1)))
    bare = F.regexp_replace("w", "-", "")
    called = lambda how, part, w, name="": F.struct(F.lit(how).alias("how"), part.alias("part"), w.alias("w"), (F.col(name) if name else F.lit("")).alias("name"))
    short = F.flatten(F.transform(letters, lambda i: F.array(called("i", i, F.col("w")), called("h", F.lit(""), F.concat(i, bare)), called("h", F.lit(""), F.concat(bare, i)))))
    long = F.when(full, F.array(called("n", F.col("g"), F.col("w")), called("s", F.substring("g", 1, 2), F.col("w"), "g"), called("h", F.lit(""), F.concat("g", bare)))).otherwise(F.array().cast("array<struct<how:string,part:string,w:string,name:string>>"))
    return sides.select("entity", "named", F.explode(F.concat(short, long)).alias("c")).select("entity", "named", "c.how", "c.part", "c.w", "c.name").where("named = 1 OR how = 'h'").distinct()


def _rematch(mine: DataFrame) -> DataFrame:
    """(own, target): the entities that leave several people possible, each with the only entity whose profile fits it.

    Forms and profiles are blocked together by one key, of the way they match, the exact part and a variant of the other;
    exact fits go before fits within one error.
    """
    how = F.when(F.col("kind") == "init", "i").when(F.col("kind") == "nick", "n").when(F.col("kind") == "short", "s").otherwise("h")
    part = F.when(F.col("kind") == "init", F.array("x")).when(F.col("kind") == "nick", F.split(F.element_at(_formals(), F.col("x")), r"\|")).when(F.col("kind") == "short", F.array(F.substring("x", 1, 2))).otherwise(F.array(F.lit("")))
    open_ = mine.where("named = 0").select("node", F.col("entity").alias("own"), how.alias("how"), F.explode(part).alias("part"), F.when(F.col("kind") == "handle", F.col("x")).otherwise(F.col("y")).alias("w0"), F.when(F.col("kind") == "short", F.col("x")).otherwise("").alias("first"))
    asked = open_.select("node", "own", "how", "part", "w0", "first", F.explode(_variants("w0")).alias("v"))
    offered = _profiles(mine).select("entity", "how", "part", F.col("w").alias("w1"), "name", F.explode(_variants("w")).alias("v"))
    fits = asked.join(offered, ["how", "part", "v"]).where("own <> entity AND startswith(name, first)").where(_one_error(F.col("w0"), F.col("w1")))
    fits = fits.select("own", "entity", (_smooth("w0") != _smooth("w1")).cast("int").alias("near")).distinct()
    best = fits.groupBy("own").agg(F.min(F.struct("near", "entity")).alias("a"), F.max(F.struct(-F.col("near"), "entity")).alias("b"))
    return best.where("a.entity = b.entity").select("own", F.col("a.entity").alias("target"))


def resolve(df: DataFrame, column: str) -> DataFrame:
    """(spelling, entity): every different non-blank spelling of df's column with the id of the entity it names.

    Null, empty and blank names belong to no entity and are left out. Spellings are compared exactly as stored; two spellings
    of one entity have one id. Everything runs on distinct spellings and then on distinct canonical keys.
    """
    spellings = df.select(F.col(column).cast("string").alias("spelling")).where("spelling IS NOT NULL AND trim(spelling) <> ''").groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))
    forms = spellings.mapInArrow(_forms, "spelling string, n long, kind string, x string, y string, initials string, given string").withColumn("node", F.xxhash64("kind", "x", "y"))
    # umlauts with and without an e are one name
    alike = F.when(F.col("kind").isin("full", "org", "init"), F.xxhash64("kind", F.array_sort(F.array(_smooth("x"), _smooth("y"))))).otherwise(F.col("node"))
    forms = cut(forms.withColumn("entity", alike))
    nodes = cut(forms.groupBy("entity", "node", "kind", "x", "y", "given").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set(F.split("initials", "")))).alias("initials")))
    entity, before = nodes.select("node", "entity"), None
    while True:
        mine = nodes.drop("entity").join(entity, "node")
        known = mine.groupBy("entity").agg(F.max(F.col("kind").isin("full", "org").cast("int")).alias("named"), F.array_distinct(F.flatten(F.collect_set("initials"))).alias("union"), F.sum("n").alias("used"))
        mine = cut(mine.join(known, "entity"))
        names = cut(_full_names(mine))
        moves = _rematch(mine)
        new = None
        if before is not None:
            # names that the last merges have brought to their entities
            new = cut(names.join(before, ["entity", "kind", "x", "y"], "left_anti").select("entity").distinct())
        if new is None or new.limit(1).count():
            near = cut(_near_names(names, new))
            moves = moves.union(_stars(near, mine.select("entity", F.col("used").alias("n")).distinct()))
        moves = cut(moves)
        # where two would join each other, only the greater id moves
        back = moves.select(F.col("own").alias("target"), F.col("target").alias("own"))
        moves = cut(moves.join(back, ["own", "target"], "left_anti").union(moves.join(back, ["own", "target"], "left_semi").where("own > target")))
        if not moves.limit(1).count():
            return forms.select("spelling", "node").join(entity, "node").select("spelling", "entity")
        step = moves.withColumnRenamed("own", "entity")
        moved = names.join(step, "entity", "left").select(F.coalesce("target", "entity").alias("entity"), "kind", "x", "y")
        before = cut(moved.distinct())
        entity = cut(entity.join(step, "entity", "left").select("node", F.coalesce("target", "entity").alias("entity")))


def variant_pairs(resolved: DataFrame) -> DataFrame:
    """(author_a, author_b): all pairs of different spellings of one entity, author_a the smaller by code points."""
    other = resolved.select("entity", F.col("spelling").alias("author_b"))
    return resolved.select("entity", F.col("spelling").alias("author_a")).join(other, "entity").where("author_a < author_b").select("author_a", "author_b")
