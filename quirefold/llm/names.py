"""Variant spellings of names typed by people.

1. Each string is read: person or organisation, family name (or the organisation's own name), and what its given names can
   be. Readings that leave more than one meaning open are all kept.
2. Readings that can meet share a block (the initial of the given name; the initials of the kind of organisation). The
   distinct names of a block are the points of a metric space under the Levenshtein distance, a true metric. Pivots divide it
   into cells; a name lies in the cell of its nearest pivot and is copied to every cell whose pivot is at most twice the
   radius farther away, which by the triangle inequality holds all names that can have a partner there. The exact radius join
   runs inside each cell, every pair once. A swap of neighbours is one slip but two edits, so the radius of the join is twice the
   number of slips.
3. Names within that number of slips whose given names can be the same are linked: a spelling links to the best established one near
   it. Links lead to the entity.

Defined results: null, blank and placeholder strings name nobody; repeated rows of one id count once; equal strings under
two ids are variants; a name that can be read in no way but as one word is its own block; strings of any length are read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quirefold.llm.cooccurrence import chunks, pairs
from quirefold.operators.skew import sized_join
from quirefold.runtime import materialize

#: Common English given names and their usual short forms. A default; a longer table can be given as a file.
GIVEN_NAMES = {
    "abigail": "abby abbie gail", "abraham": "abe bram", "adelaide": "addie heidi", "agnes": "aggie nessie", "alan": "", "albert": "al bert bertie",
    "alexander": "alex al lex sandy xander", "alexandra": "alex sandra lexie sasha", "alfred": "al alf alfie fred", "alice": "allie",
    "amanda": "mandy", "amelia": "millie amy", "anastasia": "ana stacy tasia", "andrea": "", "andrew": "andy drew", "angela": "angie",
    "anna": "ann annie nan", "anthony": "tony", "archibald": "archie", "arthur": "art artie", "barbara": "barb babs barbie",
    "bartholomew": "bart", "beatrice": "bea trixie bee", "benjamin": "ben benny benji", "bernadette": "bernie detta", "bernard": "bernie",
    "bridget": "bridie biddy", "brian": "", "caroline": "carrie caro", "catherine": "cathy kate kit kitty", "cecilia": "cis sissy",
    "charles": "charlie chuck chas", "charlotte": "lottie", "christina": "tina chrissie", "christopher": "chris kit topher", "clara": "",
    "constance": "connie", "cornelius": "con neil", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby",
    "dennis": "den", "donald": "don donny", "dorothy": "dot dottie dolly", "douglas": "doug", "edith": "edie", "edmund": "ed ned",
    "edward": "ed eddie ted teddy ned", "eleanor": "ellie nell nora nellie", "elizabeth": "liz beth eliza betty lizzie ellie libby",
    "emily": "em", "emma": "", "eric": "rick", "ernest": "ernie", "esther": "essie", "eugene": "gene", "evelyn": "evie",
    "florence": "flo flossie", "frances": "fran frankie fanny", "francis": "frank frankie", "frederick": "fred freddy freddie",
    "gabrielle": "gaby gabby", "geoffrey": "geoff jeff", "george": "georgie", "gerald": "gerry jerry", "gertrude": "trudy gertie",
    "gilbert": "gil bert", "gregory": "greg", "gwendolyn": "gwen wendy", "hannah": "", "harold": "hal harry", "harriet": "hattie",
    "helen": "nell", "henrietta": "hettie etta", "henry": "harry hank hal", "herbert": "herb bert", "hubert": "bert", "hugh": "hughie",
    "isaac": "ike", "isabel": "izzy bella belle", "isidore": "izzy dory", "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie",
    "jane": "janie", "janet": "jan", "jennifer": "jen jenny", "jeremiah": "jerry", "jeremy": "jem", "jessica": "jess jessie", "joan": "joanie",
    "john": "jack johnny jon", "jonathan": "jon jonny jack nathan", "joseph": "joe joey jos", "josephine": "jo josie", "joshua": "josh",
    "judith": "judy", "julia": "julie", "karen": "", "katherine": "kate kathy kit katie kitty", "kenneth": "ken kenny", "laura": "laurie",
    "lawrence": "larry lars laurie", "leonard": "len lenny leo", "leopold": "leo", "lewis": "lew", "lillian": "lily", "linda": "",
    "louis": "lou", "louisa": "lou lulu", "lucinda": "lu lucy cindy", "lydia": "", "magdalena": "lena maggie", "margaret": "meg peggy maggie greta madge",
    "maria": "", "marian": "", "mark": "", "martha": "mattie patty", "martin": "marty", "mary": "molly polly mamie", "matilda": "tilly maud",
    "matthew": "matt matty", "maurice": "morrie", "maximilian": "max", "melissa": "missy", "michael": "mike mick mickey", "michelle": "shelly",
    "mildred": "millie", "nancy": "", "nathaniel": "nat nate nathan", "nicholas": "nick nicky", "norman": "norm", "oliver": "ollie noll",
    "oscar": "", "pamela": "pam", "patricia": "pat patty tricia trish", "patrick": "pat paddy", "paul": "", "penelope": "penny nell",
    "peter": "pete", "philip": "phil pip", "priscilla": "cilla", "rachel": "", "ralph": "", "raymond": "ray", "rebecca": "becky",
    "reginald": "reg reggie", "richard": "rick dick richie rich", "robert": "bob rob bobby bert", "roderick": "rod roddy rick", "roger": "",
    "ronald": "ron ronnie", "rosalind": "roz rosie lindy", "rose": "rosie", "rudolph": "rudy rolf", "ruth": "", "samuel": "sam sammy",
    "sarah": "sally sadie", "sebastian": "seb", "sharon": "", "simon": "", "solomon": "sol", "sophia": "sophie", "stanley": "stan",
    "stephanie": "steph", "stephen": "steve stevie", "stuart": "stu", "susan": "sue susie", "susannah": "sue susie zanna", "sylvia": "",
    "theodore": "theo ted teddy", "theresa": "tess terry tessa", "thomas": "tom tommy", "timothy": "tim", "ursula": "", "valerie": "val",
    "veronica": "vera ronnie roni", "victor": "vic", "victoria": "vicky tori", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt wally",
    "wilfred": "wilf fred", "wilhelmina": "wilma billie mina minnie", "william": "will bill billy liam", "winifred": "win winnie freda",
    "zachary": "zach",
}
#: Words that name a kind of organisation, with their abbreviations. A default as well.
ORG_WORDS = {
    "academy": "acad", "agency": "", "archive": "archives", "association": "assoc assn", "board": "", "bureau": "", "centre": "center ctr",
    "college": "coll", "commission": "comm", "committee": "cttee", "company": "co", "corporation": "corp", "council": "", "department": "dept dep",
    "field": "fld", "foundation": "found fdn", "guild": "", "historical": "hist", "hydrography": "hydrogr", "institute": "inst institution",
    "laboratory": "lab", "library": "libr lib", "limited": "ltd", "ministry": "min", "museum": "mus", "natural": "nat", "observatory": "obs",
    "office": "off", "press": "pr publ publisher publishers", "school": "", "science": "sci", "service": "", "society": "soc", "survey": "surv",
    "trust": "tr", "union": "", "university": "univ", "works": "wks",
}
#: Fixed values.
TITLES = {"dr", "prof", "professor", "mx", "mr", "mrs", "ms", "miss", "sir", "dame", "rev", "doctor"}
SUFFIXES = {"jr", "sr", "msc", "phd", "bsc", "esq", "md", "editor", "ii", "iii"}
NOBODY = {"", "unknown", "anonymous", "anon", "na", "none", "null", "nobody", "noname", "nn", "various", "tbd", "author", "noauthor", "unnamed", "notknown"}
LINKING = {"of", "the", "and", "for", "de"}
#: How many times the rows of a spelling the established one must have at least, by the slips between them.
SHARES = {1: 2, 2: 5, 3: 25}
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})

READINGS = "id bigint, node string, block string, name string, given array<string>, firm boolean"


def fold(text: str) -> str:
    """Lower case without marks."""
    flat = unicodedata.normalize("NFKD", text.casefold().translate(_LETTERS))
    return "".join(c for c in flat if not unicodedata.combining(c))


def edits(a: str, b: str, most: int) -> int:
    """Edits (a swap of neighbours is one) between two words, most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


class Words:
    """Looks up words that may be misspelt, in a small vocabulary with the meanings of each word."""

    def __init__(self, table: dict[str, str]) -> None:
        self.means: dict[str, set[str]] = {}
        for name, short in table.items():
            for w in (name, *short.split()):
                self.means.setdefault(w, set()).add(name)
        for name in table:  # a full name means itself only
            self.means[name] = {name}
        self.cut: dict[str, set[str]] = {}
        for w in self.means:
            if len(w) > 3:
                for c in self._cuts(w):
                    self.cut.setdefault(c, set()).add(w)
        self.near = lru_cache(200_000)(self._near)

    @staticmethod
    def _cuts(w: str) -> set[str]:
        one = {w[:i] + w[i + 1 :] for i in range(len(w))}
        two = {x[:i] + x[i + 1 :] for x in one for i in range(len(x))} if len(w) > 4 else set()
        return {w} | one | two

    def _near(self, word: str) -> tuple[int, frozenset[str]]:
        """(edits, meanings) of the nearest words: none may be wrong up to 3 letters, one up to 5, else two."""
        if word in self.means:
            return 0, frozenset(self.means[word])
        allowed = 0 if len(word) < 4 else 1 if len(word) < 6 else 2
        best, found = allowed + 1, set()
        for w in {x for c in self._cuts(word) for x in self.cut.get(c, ())} if allowed and len(word) < 24 else ():
            if (d := edits(word, w, 2)) <= min(best, allowed, 1 if len(w) < 6 else 2):
                found = (found if d == best else set()) | self.means[w]
                best = d
        return best, frozenset(found)


def _strip(tokens: list[str]) -> list[str]:
    while len(tokens) > 1 and tokens[0] in TITLES:
        tokens = tokens[1:]
    while len(tokens) > 2 and tokens[-1] in SUFFIXES:
        tokens = tokens[:-1]
    return tokens


#: Stands before a given name that no table has.
OTHER = "~"


class Reader:
    """Reads names by two tables of words: given names and kinds of organisations, each with its short forms."""

    def __init__(self, given: dict[str, str] | None = None, kinds: dict[str, str] | None = None) -> None:
        self.given_names, self.kinds = GIVEN_NAMES if given is None else given, ORG_WORDS if kinds is None else kinds
        self.given, self.org = Words(self.given_names), Words(self.kinds)

    @classmethod
    def load(cls, path: str) -> Reader:
        """From a JSON file {"given": {name: "short forms"}, "kinds": {word: "abbreviations"}}; either may be left out."""
        with open(path, encoding="utf-8") as f:
            tables = json.load(f)
        return cls(tables.get("given"), tables.get("kinds"))

    def __reduce__(self):
        return Reader, (self.given_names, self.kinds)

    def person(self, given: list[str], surname: str) -> list[tuple[str, str, tuple[str, ...]]]:
        """(block, name, given names it can be); one reading per possible initial."""
        first = given[0] if given else ""
        if not first:
            return [("?", surname, ())]
        d, names = self.given.near(first)
        if not names and len(first) <= 2:
            return [(first[0], surname, ())]
        by: dict[str, list[str]] = {}
        for n in sorted(names) or [OTHER + first]:
            by.setdefault(n.lstrip(OTHER)[0], []).append(n)
        return [(block, surname, tuple(n)) for block, n in sorted(by.items())]

    def place(self, tokens: list[str]) -> tuple[list[str], str]:
        """Given names and family name of words without a comma."""
        if len(tokens) == 1:
            return [], tokens[0]
        first, last = tokens[0], tokens[-1]
        long = [t for t in tokens if len(t) > 2]
        if len(long) == 1:  # all others are initials or a short form like Al
            return [t for t in tokens if t != long[0]], long[0]
        if len(first) <= 2:
            return tokens[:-1], last
        if len(last) <= 2:  # Family Given M, or Given Family MM
            return (tokens[1:], first) if len(tokens) == 2 or self.given.near(first)[0] > self.given.near(tokens[1])[0] else ([first], tokens[-2])
        a = self.given.near(first)
        b = self.given.near(tokens[1])
        if a[1] and (not b[1] or a[0] <= b[0] or len(tokens) > 2):
            return tokens[:-1], last
        return (tokens[1:], first) if b[1] else (tokens[:-1], last)

    def read(self, name: str | None) -> list[tuple[str, str, tuple[str, ...]]]:
        """The readings of one string: (block, name, given names or kind of organisation; empty if open)."""
        if not name:
            return []
        text = " ".join(unicodedata.normalize("NFKC", name).split())
        if re.sub(r"[\W\d_]", "", fold(text)) in NOBODY:
            return []
        if mail := re.search(r"<\s*([^<>@\s]+)@", text):
            parts = re.findall(r"[^\W\d_]+", fold(mail[1]))
            if len(parts) > 1:
                return self.person(parts[:-1], parts[-1])
        flat = fold(re.sub(r"<[^>]*>", " ", text)).strip()
        if handle := re.fullmatch(r"@([^\W_]+)", flat):
            return self.person([handle[1][0]], handle[1][1:]) if len(handle[1]) > 3 else [("?", handle[1], ())]
        if parts := re.fullmatch(r"@?([^\W\d_]+)[._]([^\W\d_]{2,})", flat):
            return self.person([parts[1]], parts[2])
        everything = re.findall(r"[^\W\d_]+", flat.replace("'", "").replace("’", ""))
        kinds = [(t, *self.org.near(t)) for t in everything if t not in LINKING]
        kind, own = {}, []
        for t, d, means in kinds:
            if means and not (d and self.given.near(t)[0] < d) and not (len(t) <= 3 and t in self.given_names):
                kind[t] = sorted(means)[0]
            else:
                own.append(t)
        # Abbreviations of three letters and less count beside another word of the kind, or with a point.
        sure = [t for t in kind if len(t) > 3 or re.search(rf"\b{t}\.", flat) or t in ("dept", "inst")]
        if own and sure:
            words = sorted(set(kind.values()))
            return [("o:" + "".join(sorted(w[0] for w in words)), " ".join(sorted(own)), (" ".join(words),))]
        tokens = re.findall(r"[^\W\d_]+", re.sub(r"\([^)]*\)", " ", flat).replace("'", "").replace("’", ""))
        comma = flat.find(",")
        if comma > 0:
            left = _strip(re.findall(r"[^\W\d_]+", flat[:comma].replace("'", "")))
            right = [t for t in _strip(re.findall(r"[^\W\d_]+", re.sub(r"\([^)]*\)", " ", flat[comma:]))) if t not in SUFFIXES or len(t) < 3]
            if left and right and right[0] not in SUFFIXES:
                return self.person(right, max(left, key=len))
            tokens = left or right
        tokens = _strip(tokens)
        if not tokens:
            return []
        given, surname = self.place(tokens)
        out = self.person(given, surname)
        if len(tokens) == 2 and len(given) == 1 and len(given[0]) == 2 and tokens[1] == given[0] and not self.given.near(given[0])[1]:
            out.append(("o:" + "".join(sorted(given[0])), surname, ()))  # initials may be those of a kind of organisation
        return out


_usual = Reader()
read = _usual.read


def readings(authors: DataFrame, id_col: str, name_col: str, reader: Reader | None = None) -> DataFrame:
    """READINGS of every row that names somebody. node: equal for rows with equal readings. firm: one reading, one meaning."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads = (reader or _usual).read
        for batch in batches:
            rows = []
            for i, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = reads(name)
                node = "/".join(f"{b}:{n}:{'|'.join(g)}" for b, n, g in found)
                rows += [(i, node, b, n, list(g), len(found) == 1 and len(g) == 1) for b, n, g in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "node", "block", "name", "given", "firm"]
            )

    source = authors.where(F.col(id_col).isNotNull() & F.col(name_col).isNotNull())
    return source.select(F.col(id_col).cast("bigint").alias("i"), F.col(name_col).alias("n")).mapInArrow(work, READINGS)


def _bit(char):
    """One of 64 bits for a letter; the empty string has none."""
    return F.when(char == "", F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(char) % 64))


def radius_join(points: DataFrame, radius: int, cell_size: int = 500, max_pivots: int = 64, swaps: bool = False) -> DataFrame:
    """(block, name_a, name_b, d) of all names of a block within `radius`, name_a < name_b, by pivots.

    swaps: `radius` counts edits and swaps of neighbours. All such pairs and some others are given, d is their Levenshtein
    distance, in which a swap is two edits: 2 * radius at most.

    points: distinct (block, name). A block of n names gets n / cell_size pivots, max_pivots at most, those with the least
    hashes; their number shapes the work only. A cell that still has more than cell_size names is divided into products of chunks of
    about that many, so no task's share grows with the block.
    """
    reach = 2 * radius if swaps else radius
    sizes = points.groupBy("block").agg(F.ceil(F.count("*") / cell_size).cast("int").alias("k"))
    first = Window.partitionBy("block").orderBy(F.xxhash64("name"), "name")  # only max_pivots rows a block leave each task
    ranked = points.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max_pivots)
    pivots = ranked.join(sizes, "block").where("r <= k").groupBy("block").agg(F.array_sort(F.collect_list("name")).alias("p"))
    placed = sized_join(points, materialize(pivots, "pivots"), ["block"]).withColumn("ds", F.transform("p", lambda x: F.levenshtein("name", x)))
    near = placed.withColumn("least", F.array_min("ds")).select("block", "name", "least", F.posexplode("ds").alias("cell", "d"))
    cells = materialize(near.where(F.col("d") <= F.col("least") + 2 * reach), "cells")
    # Home: the first cell at the least distance. Both sides carry cheap lower bounds of the distance: to the pivot, the length
    # and which letters occur (an edit brings one letter at most, and takes one at most; a swap none).
    letters = F.aggregate(F.split("name", ""), F.lit(0).cast("bigint"), lambda m, c: m.bitwiseOR(_bit(c)))
    cells = cells.withColumn("size", F.length("name")).withColumn("letters", letters)
    home = F.struct("cell", "d", "size", "letters")
    a = cells.where("d = least").groupBy("block", "name").agg(F.min(home).alias("h")).select("block", "name", "h.*")
    a = materialize(a, "homes")
    # Cells of more than cell_size names are products of chunks: each chunk of the names at home meets each chunk of all.
    pieces = lambda rows, k: rows.groupBy("block", "cell").agg(F.ceil(F.count("*") / cell_size).cast("int").alias(k))
    shape = materialize(pieces(a, "ka").join(pieces(cells, "kb"), ["block", "cell"]), "shape")
    side = lambda rows, s: rows.join(shape, ["block", "cell"]).select(
        "block", "cell", "ka", "kb", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "d", "size", "letters")]
    )
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    chunk = lambda s: F.pmod(F.xxhash64(f"name_{s}"), F.col(f"k{s}")).cast("int")
    left = side(a, "a").withColumn("i", chunk("a")).withColumn("j", every("kb")).drop("ka", "kb")
    right = side(cells, "b").withColumn("j", chunk("b")).withColumn("i", every("ka")).drop("ka", "kb")
    both = left.join(right, ["block", "cell", "i", "j"])
    differ = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    within = lambda n: (F.abs(F.col("size_a") - F.col("size_b")) <= n) & (differ("letters_a", "letters_b") <= n) & (differ("letters_b", "letters_a") <= n)
    both = both.where(F.abs(F.col("d_a") - F.col("d_b")) <= reach).where(within(radius)).where("name_a < name_b")
    near = both.withColumn("d", F.levenshtein("name_a", "name_b", reach)).where("d >= 0")
    if swaps:  # a distance of radius + s takes s swaps at least, and leaves radius - s edits
        near = near.where((F.col("d") <= radius) | within(2 * radius - F.col("d")))
    return near.select("block", "name_a", "name_b", "d")


@F.pandas_udf(IntegerType())
def slips(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else edits(x, y, 3) for x, y in zip(a, b, strict=True)], dtype="Int32")


def alike(given_a: str, given_b: str):
    """Whether two given names of which no table has one or both can be the same: a slip apart (from four letters on; two from
    seven on), or one a short form of the other: its three or four letters without a final y or ie begin it."""

    def one(x, y):
        bare = lambda c: F.regexp_replace(c, f"^{OTHER}", "")
        a, b = bare(x), bare(y)
        least = F.least(F.length(a), F.length(b))
        near = F.levenshtein(a, b) <= F.when(least >= 7, 2).when(least >= 4, 1).otherwise(0)
        stem = lambda c: F.regexp_replace(c, "(?<=...)(y|ie)$", "")
        short = lambda c, d: F.length(stem(c)).between(3, 4) & (F.length(d) > F.length(c)) & F.startswith(d, stem(c))
        return (x.startswith(OTHER) | y.startswith(OTHER)) & (near | short(a, b) | short(b, a))

    return F.exists(given_a, lambda x: F.exists(given_b, lambda y: one(x, y)))


def links(reads: DataFrame, radius: int = 3) -> DataFrame:
    """(node, parent): every node that is not the best of its neighbours, with the one it means the same as.

    A rare spelling near an established one (rows counted over all given names) is taken for slips of it if it has at most
    1/SHARES[slips] of its rows. Half of its rows (for one slip: as many) are allowed if that is no more than the rarest reading
    of it has. Both compare rows with rows, so the same rows many times over give the same links. Three slips need an equal
    given name on both sides. A slip is an edit or a swap of neighbours; the radius counts slips.
    """
    nodes = reads.groupBy("node", "block", "name").agg(
        F.countDistinct("id").alias("n"), F.first("given").alias("given"), F.first("firm").alias("firm")
    )
    nodes = materialize(nodes, "nodes")
    weights = reads.select("name", "id").distinct().groupBy("name").agg(F.count("*").alias("w"))
    rarest = nodes.groupBy("name").agg(F.min("n").alias("u"))
    full = materialize(nodes.join(weights, "name").join(rarest, "name"), "weighted")
    near = radius_join(full.select("block", "name").distinct(), radius, swaps=True)
    more = lambda c: F.when(F.col("d") > 1, F.col(c))  # noqa: E731 (one edit is one slip: such pairs are null to Python)
    near = near.select("block", "name_a", "name_b", F.coalesce(slips(more("name_a"), more("name_b")), F.lit(1)).alias("d"))
    same = full.select("block", F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(0).alias("d")).distinct()
    flip = near.select("block", F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), "d")
    close = materialize(near.unionByName(flip).unionByName(same), "close").where(F.col("d") <= radius)
    side = lambda s: full.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "node", "n", "given", "firm", "w", "u")])
    met = close.join(side("a"), ["block", "name_a"]).join(side("b"), ["block", "name_b"]).where("node_a <> node_b")
    rank = lambda s: F.struct(f"firm_{s}", f"w_{s}", f"n_{s}", f"node_{s}")
    agree = (F.size("given_a") == 0) | (F.size("given_b") == 0) | F.arrays_overlap("given_a", "given_b") | alike("given_a", "given_b")
    rarer, known = F.least("w_a", "w_b"), F.col("firm_a") & F.col("firm_b")
    most = F.greatest("w_a", "w_b")
    alone = (F.col("w_b") == most) & (rarer <= F.col("u_b")) | (F.col("w_a") == most) & (rarer <= F.col("u_a"))
    slip = lambda d: (F.col("d") == d) & (alone & (rarer * min(d, 2) <= most) | (rarer * SHARES[d] <= most))
    likely = (F.col("d") == 0) | slip(1) | slip(2) | (slip(3) & known & (F.length("name_a") >= 8))
    up = met.where(agree & likely).withColumn("higher", rank("b") > rank("a")).where("higher")
    order = F.struct(F.col("firm_b"), -F.col("d"), F.col("w_b"), F.col("n_b"), F.col("node_b"))
    best = up.groupBy(F.col("node_a").alias("node")).agg(F.max(order).alias("m"))
    return best.select("node", F.col("m")["node_b"].alias("parent"))


def entities(authors: DataFrame, id_col: str, name_col: str, radius: int = 3, reader: Reader | None = None) -> DataFrame:
    """(id, entity) of every row that names somebody; entity is a text equal for all variants of one name. reader: with other
    tables of words than the usual ones."""
    reads = materialize(readings(authors, id_col, name_col, reader), "readings")
    parents = materialize(links(reads, radius), "parents")
    rows = reads.select("id", "node").distinct()
    # Links go upwards in a strict order, so chains end. Each round doubles the steps taken.
    while True:
        further = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = materialize(parents.join(further, "parent", "left").select("node", "parent", "next"), "parents")
        parents = jumped.select("node", F.coalesce("next", "parent").alias("parent"))
        if jumped.where("next IS NOT NULL").isEmpty():
            break
    joined = sized_join(rows, parents, ["node"], "left")
    return joined.select("id", F.coalesce("parent", "node").alias("entity")).groupBy("id").agg(F.min("entity").alias("entity"))


def variant_pairs(members: DataFrame, chunk: int = 128) -> DataFrame:
    """(author_id_a, author_id_b) of all rows of one entity, the smaller id first; large entities by chunks."""
    uses = members.select(F.col("entity").alias("basket"), F.col("id").alias("item"))
    both = pairs(materialize(chunks(uses, chunk), "members"))
    return both.select(F.col("a").alias("author_id_a"), F.col("b").alias("author_id_b"))
