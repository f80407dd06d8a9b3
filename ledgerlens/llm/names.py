"""Problem 3: variant spellings of names, tied to the party that they name."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.components import components
from ledgerlens.llm.lookalikes import code_point_counts, representatives, rewrite_column
from ledgerlens.plans.runtime import Stages, is_small, ship_code, spread, table, with_value

#: A word of the register that this many organisations (persons) have is a line of business (a given name), not a name.
COMMON = 5
#: Longer words are not kept by the workers; their codes are blocked by both ends.
LONGEST = 40
#: Keys of the register that are broadcast at most.
REGISTER_KEYS = 200_000
#: Sounds at each end of a long code that are blocked.
END = 20
#: Least Jaro-Winkler similarity of two words that may be the same one.
SIMILAR = 0.80

# Short forms of given names, as dictionaries of English, German, Spanish, French, Italian, Dutch and Polish names have them.
NICKNAMES = {
    "abigail": "abby gail", "adelheid": "heidi adele", "albert": "al bert bertie albrecht", "alejandra": "ale sandra jandra", "alessandro": "sandro ale",
    "alexander": "alex sascha sasha sandy xander lex al alec alejandro ale", "alexandra": "alex sandra sascha sasha lexi", "alfonso": "poncho fonso", "alfred": "alf fred freddy", "amelia": "amy millie mel",
    "andreas": "andi andy andre", "andrew": "andy drew andi", "angelika": "angie geli", "anthony": "tony ant", "antonio": "tono toni tonio", "barbara": "babs barb barbie bobbie", "bartholomew": "bart barty",
    "beatrice": "bea trixie", "benjamin": "ben benny benji", "bernhard": "bernd berni hardy", "brigitte": "gitte gitta biggi", "caroline": "carrie caro lina", "catherine": "cathy kate cat", "charles": "charlie chuck",
    "christian": "chris krisz", "christina": "chris tina christi kristina", "christopher": "chris kit topher", "concepcion": "concha conchita", "cornelia": "conny nelly", "daniel": "dan danny dani", "david": "dave davey",
    "deborah": "deb debbie", "dolores": "lola lolita", "dorothea": "doro thea dora dolly dot dorle dorothy", "eduardo": "edu lalo", "edward": "ed eddie ned ted teddy",
    "eleanor": "ellie nell nora", "elizabeth": "liz beth betty eliza lisa bess lizzie betsy liesl elsa elisabeth libby", "emanuele": "lele manu", "enrique": "quique kike", "esperanza": "espe pera",
    "ferdinand": "ferdi nando", "fernando": "nando fer", "florian": "flo flori", "frances": "fran franny fanny", "francesco": "franco cecco ciccio", "francisco": "paco pancho curro fran kiko frank cisco quico franco",
    "franziska": "franzi fanny", "frederick": "fred freddy fritz", "friedrich": "fritz fred friedel", "gabriele": "gabi gaby", "georg": "schorsch jorg", "gerhard": "gerd hardy", "gertrude": "trudi trude gertie", "giovanni": "gianni vanni nino",
    "giuseppe": "beppe peppe pino", "gregory": "greg", "guadalupe": "lupe lupita pita guada", "guillermo": "guille memo", "harold": "harry hal", "heinrich": "heiner heinz henry", "helene": "leni lena hella", "henry": "harry hank hal",
    "ignacio": "nacho iggy nacio inaki", "isabel": "isa bel chabela", "jacob": "jake jakob", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "joachim": "jochen achim", "johanna": "hanna jo",
    "johannes": "hannes hans jo jan john johann joh", "jonathan": "jon jonny nathan", "josef": "sepp beppo jupp", "josefina": "pepa fina josie jo jose josefa pepita sefa", "joseph": "joe joey", "joshua": "josh", "judith": "judy jutta",
    "katharina": "kathe kathi kate kathy katja kati kat rina trina", "kenneth": "ken kenny", "klaus": "niklaus", "lawrence": "larry laurie", "leonard": "leo len lenny", "leonardo": "leo nardo", "ludwig": "lutz wiggerl", "luis": "lucho", "magdalena": "lena magda leni",
    "manuel": "manolo manu", "margaret": "maggie meg peg peggy greta marge margo rita madge daisy", "maria": "mari mia", "martin": "marty", "matthew": "matt matty", "matthias": "matze hias", "maximilian": "max maxi", "mercedes": "merche meche", "michael": "mike mick michi", "nathaniel": "nate nat",
    "nicholas": "nick nicky", "nikolaus": "klaus niko nick nico nicki claus", "pamela": "pam", "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "rafael": "rafa", "raymond": "ray", "rebecca": "becky becca", "reinhard": "reini", "ricardo": "richi rico",
    "richard": "dick rick richie", "robert": "bob rob bobby bert robbie robin", "roberto": "beto berto", "ronald": "ron ronnie", "rosario": "charo", "salvatore": "toto turi", "samuel": "sam sammy", "santiago": "santi yago chago", "sebastian": "basti seb wastl", "stanislaw": "staszek stas", "stephen": "steve stevie", "susan": "sue susie suzy",
    "theodore": "ted theo teddy dora", "theresa": "resi terry tess", "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli ulli", "ursula": "uschi ulla ursel ursi uli", "valentin": "vale valli", "veronica": "ronnie vero", "vicente": "chente", "victor": "vic", "victoria": "vicky vicki tori vic viki toria", "vincent": "vince vinnie",
    "walter": "walt wally", "wilhelm": "willi willy will", "william": "bill will willy liam billy willi wilhelm", "wolfgang": "wolf wolfi", "zbigniew": "zbyszek",
}
# Legal forms without marks, forms of address, and words that join two names.
LEGAL = {
    "sa", "sl", "slu", "sau", "nv", "bv", "spa", "srl", "sarl", "sas", "gmbh", "ag", "kg", "llc", "llp", "ltd", "plc", "inc", "corp", "spzoo",
    "limited", "corporation", "incorporated", "company", "co", "ohg", "ug", "ab", "oy", "as", "aps", "lda", "kk", "se", "eurl", "sc", "snc", "sp", "zoo", "unipersonal",
}
LEGAL_PHRASES = (
    (r"\bgesellschaft m(?:it )?b(?:eschrankter )?h(?:aftung)?\b", "gmbh"), (r"\bspolka z o ?o\b", "spzoo"), (r"\bsp z o ?o\b", "spzoo"),
    (r"\bpublic limited company\b", "plc"), (r"\bsociedad anonima\b", "sa"), (r"\bsociedad limitada\b", "sl"), (r"\bsociete anonyme\b", "sa"),
    (r"\bkommanditgesellschaft\b", "kg"), (r"\baktiengesellschaft\b", "ag"),
)
TITLES = set("mr mrs ms miss mx herr frau fr hr dr prof sr sra srta don dona dna sig sra signor signora m mme mlle pan pani dhr mevr mw ing dipl lic dott sig ra".split())
JOINTS = {"&", "+", "y", "u", "und", "and", "et", "e", "i", "en"}
# Letters that do not decompose.
PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"})


def folded(text: str) -> str:
    """Without case and accents."""
    text = unicodedata.normalize("NFKD", text.casefold().translate(PLAIN))
    return "".join(c for c in text if not unicodedata.combining(c))


def spelt(word: str) -> str:
    """A word as it sounds, vowels kept: one letter for each sound, doubled letters once."""
    return _spelt(word) if len(word) <= LONGEST else _spelt.__wrapped__(word)


@functools.lru_cache(100_000)
def _spelt(word: str) -> str:
    for a, b in (("vv", "w"), ("ph", "f"), ("qu", "kw"), ("ae", "a"), ("oe", "o"), ("ue", "u"), ("ck", "k"), ("th", "t"), ("x", "ks"), ("q", "k"), ("c", "k"), ("y", "i"), ("z", "s"), ("w", "v"), ("j", "i")):
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def phonetic(word: str) -> str:
    """Code of a word: its first sound and the consonants after it; in another script all of its letters."""
    s = spelt(word)
    return (re.sub(r"(.)\1+", r"\1", re.sub(r"[aeiouh]", "", s)) or s) if s.isascii() else s


def tokens(text: str) -> list[str]:
    """Words of a name: folded, legal forms joined, marks gone, words that lost their blank cut where the case changes."""
    text = re.sub(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])", " ", text)
    # S. A., S.p.A., Sp. z o.o.: letters with points are one word.
    text = folded(text)
    text = re.sub(r"(?<![^\W\d_])(?:[a-z]\.\s?){2,}(?:[a-z](?![^\W\d_]))?", lambda m: " " + re.sub(r"[.\s]", "", m[0]) + " ", text)
    text = re.sub(r"\bs\.p\.a\b\.?", " spa ", text)
    text = re.sub(r"\bsp\.? ?z\.? ?o\.? ?o\b\.?", " spzoo ", text)
    text = re.sub(r"[^\w&+]+|_", " ", text)
    for pattern, short in LEGAL_PHRASES:
        text = re.sub(pattern, short, text)
    return text.split()


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two words from 0 to 1."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(n, m) // 2 - 1
    used = [False] * m
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    others = [b[j] for j in range(m) if used[j]]
    swapped = sum(x != y for x, y in zip(hits, others)) / 2
    k = len(hits)
    jaro = (k / n + k / m + (k - swapped) / k) / 3
    prefix = 0
    while prefix < min(4, n, m) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def edits(a: str, b: str, most: int = 3) -> int:
    """Letters put in, left out, changed or swapped with the next one; ``most`` + 1 if there are more."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    before, last = None, [j if j <= most else far for j in range(m + 1)]
    for i, c in enumerate(a, 1):
        # Only what lies within ``most`` of the diagonal can still come out.
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(m, i + most) + 1):
            d = b[j - 1]
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
            if before is not None and j > 1 and c == b[j - 2] and a[i - 2] == d:
                cost = min(cost, before[j - 2] + 1)
            row[j] = cost
        if min(row) > most:
            return far
        before, last = last, row
    return min(last[m], far)


def letters(word: str) -> int:
    """A bit for each letter of a word; letters that share a bit only make two words seem nearer."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def allowed(n: int) -> int:
    """Edits in a word whose shorter spelling has n letters."""
    return 0 if n < 3 else 1 if n < 5 else 2 if n < 9 else 3


def same_word(a: str, b: str) -> float:
    """Jaro-Winkler similarity of two spellings, 0 if they are too different for one word."""
    if a == b:
        return 1.0
    return _same_word(a, b) if max(len(a), len(b)) <= LONGEST else _same_word.__wrapped__(a, b)


@functools.lru_cache(300_000)
def _same_word(a: str, b: str) -> float:
    x, y = spelt(a), spelt(b)
    if x == y:
        return 0.99
    most = allowed(min(len(a), len(b)))
    if not most:
        return 0.0
    # Every letter that only one of the words has takes half an edit at least.
    near = lambda u, v: (letters(u) ^ letters(v)).bit_count() <= 2 * most and edits(u, v, most) <= most
    if not (near(x, y) or near(a, b)):
        return 0.0
    s = max(jaro_winkler(a, b), jaro_winkler(x, y))
    return s if s >= SIMILAR else 0.0


class Words:
    """Words of a fixed list that a spelling may be, found without comparing it with each of them in full."""

    def __init__(self, words: list[str]):
        self.words = [(w, len(w), spelt(w), letters(w), letters(spelt(w))) for w in words]
        self.known: dict[str, dict[str, float]] = {}

    def like(self, word: str) -> dict[str, float]:
        """The words that ``same_word`` takes for ``word``, with their similarity."""
        found = self.known.get(word)
        if found is None:
            n, x = len(word), spelt(word)
            own, sound = letters(word), letters(x)
            found = {}
            for w, size, spoken, bits, heard in self.words:
                most = 2 * allowed(min(n, size))
                if ((sound ^ heard).bit_count() <= most or (own ^ bits).bit_count() <= most or x == spoken) and (s := same_word(word, w)):
                    found[w] = s
            if n <= LONGEST:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[word] = found
        return found


def shortened(short: str, full: str) -> bool:
    """Whether ``short`` abbreviates ``full``: its letters in order, from the first one on."""
    if len(short) < 2 or len(short) >= len(full) or short[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


class Register:
    """Vocabulary of the register: lines of business and given names, by how many parties have them."""

    def __init__(self, business: list[str], given: list[str]):
        self.business, self.given = frozenset(business), frozenset(given)
        self.spoken = [(b, spelt(b)) for b in sorted(self.business)]
        self.longest = max((len(x) for _, x in self.spoken), default=0) + 8
        self.kinds: dict[str, frozenset[str]] = {}
        self.near_business, self.near_given = Words(sorted(self.business)), Words(sorted({*given, *NICKNAMES}))
        self.nick: dict[str, set[str]] = {}
        for full, short in NICKNAMES.items():
            for s in [full, *short.split()]:
                self.nick.setdefault(s, set()).add(full)

    def business_of(self, word: str) -> frozenset[str]:
        """Lines of business that a word stands for, best reading only."""
        if len(word) > LONGEST:
            return frozenset(self._business_of(word))
        if word not in self.kinds:
            if len(self.kinds) > 200_000:
                self.kinds.clear()
            self.kinds[word] = frozenset(self._business_of(word))
        return self.kinds[word]

    def _business_of(self, word: str) -> set[str]:
        if word in self.business:
            return {word}
        x = spelt(word)
        if len(word) >= 3 and (begins := {b for b, s in self.spoken if b.startswith(word) or s.startswith(x)}):
            return begins
        near = self.near_business.like(word) if len(word) >= 5 else {}
        if near and max(near.values()) >= 0.88:
            return {b for b, s in near.items() if s == max(near.values())}
        return {b for b in self.business if shortened(word, b)}

    def glued(self, word: str) -> list[tuple[str, str]]:
        """Ways to cut a word that lost a blank into a line of business, or its short form, and a rest."""
        n, found = len(word), set()
        for k in range(3, n - 2):
            # A longer beginning sounds longer still: it can be no line of business.
            if len(spelt(word[:k])) > self.longest:
                break
            if n - k > 3 and self.business_of(word[:k]):
                found.add(k)
        for k in range(n - 3, 2, -1):
            if len(spelt(word[k:])) > self.longest:
                break
            if k > 3 and self.business_of(word[k:]):
                found.add(k)
        return [(word[:k], word[k:]) for k in sorted(found)]


@functools.lru_cache(4)
def vocabulary_of(business: tuple[str, ...], given: tuple[str, ...]) -> Register:
    """The register's vocabulary with what a worker has learnt so far; kept from task to task."""
    return Register(list(business), list(given))


class Party:
    __slots__ = ("party_id", "name", "person", "core", "business", "given", "city")

    def __init__(self, party_id: int, name: str, kind: str, city: str, reg: Register):
        self.party_id, self.name, self.person = party_id, name, kind == "person"
        words = [t for t in tokens(name) if t not in JOINTS]
        self.city = set(tokens(city or ""))
        if self.person and len(words) > 1:
            self.given, self.core, self.business = words[0], words[1:], None
        else:
            self.given = None
            rest = [w for w in words if w not in LEGAL]
            self.business = next((w for w in rest if w in reg.business), None)
            self.core = [w for w in rest if w != self.business] or rest


def explained(word: str, party: Party) -> bool:
    """Whether a word that is left over says nothing about who is meant."""
    return word in LEGAL or word in JOINTS or word in TITLES or any(same_word(word, c) for c in party.city)


def fit(words: list[str], party: Party, reg: Register) -> float:
    """How well the words of a value name a party: 0 if they don't, at most 2."""
    left = list(words)

    def take(target: str) -> float:
        scored = [(same_word(w, target), -k, w) for k, w in enumerate(left)]
        best = max(scored, default=(0.0, 0, ""))
        if best[0]:
            left.remove(best[2])
        return best[0]

    total = 0.0
    for core in party.core:
        s = take(core)
        if not s:
            return 0.0
        total += s
    total /= max(1, len(party.core))
    if party.person:
        if not party.given:
            return total if all(explained(w, party) for w in left) else 0.0
        best, which = 0.0, None
        for w in left:
            if w == party.given:
                s = 1.0
            elif party.given in reg.nick.get(w, ()):
                s = 0.95
            elif len(w) == 1 and w == party.given[0]:
                s = 0.7
            elif len(w) > 3 and (s := same_word(w, party.given)):
                closer = max((x for g, x in reg.near_given.like(w).items() if g != party.given), default=0.0)
                s = 0.9 * s if s > closer and w not in reg.nick else 0.0
            else:
                s = 0.0
            if s > best:
                best, which = s, w
        if which is None:
            return 0.0
        left.remove(which)
        return total + best if all(explained(w, party) or len(w) == 1 for w in left) else 0.0
    if party.business:
        for w in left:
            if party.business in reg.business_of(w) and not any(w == c for c in party.city):
                left.remove(w)
                total += 1 if w == party.business else 0.9
                break
        else:
            return 0.0
    else:
        total += 1
    return total if all(explained(w, party) for w in left) else 0.0


def readings(text: str, reg: Register) -> tuple[list[list[str]], dict[str, list[tuple[str, str]]]]:
    """The words of a value, also with short forms such as E-Technik and Masch.bau as one word; and, if no word is a line of
    business or a given name, the ways to cut each word that lost its blank."""
    words = tokens(text)
    out = [words]
    one = tokens(re.sub(r"(?<=[^\W\d_])[.\-](?=[^\W\d_]{2})", "", text))
    if len(one) < len(words):
        out.append(one)
    cuts = {}
    if not any(reg.business_of(w) or w in reg.given or w in reg.nick for w in set(words)):
        cuts = {w: found for w in dict.fromkeys(words) if len(w) > 7 and (found := reg.glued(w))}
    return out, cuts


def fits(read: tuple[list[list[str]], dict[str, list[tuple[str, str]]]], party: Party, reg: Register) -> float:
    """The best fit of all readings of a value."""
    whole, cuts = read
    words = whole[0]
    # Core, given name and line of business take a word each; of a longer value all others must be explained.
    if len(words) > 2 * len(party.core) + 8 and sum(len(w) > 1 and not explained(w, party) for w in words) > len(party.core) + 1:
        return 0.0
    best = max(fit(r, party, reg) for r in whole)
    for w, found in cuts.items():
        k = words.index(w)
        best = max(best, *(fit([*words[:k], *cut, *words[k + 1 :]], party, reg) for cut in found))
    return best


def without_one(codes: set[str]) -> set[str]:
    """The codes with one sound left out."""
    return {re.sub(r"(.)\1+", r"\1", c[:k] + c[k + 1 :]) for c in codes for k in range(len(c))}


def lossy(code: str, register: bool) -> set[str]:
    """A code, and what is left of it with sounds left out: up to two of a code of the register, one of a value's, or two if it is long.

    A code of more than twice END sounds is blocked by both of its ends, with one sound left out: of two slips one end has
    one at most. So a code of any length has few keys.
    """
    if len(code) > 2 * END:
        ends = ("<" + code[:END], ">" + code[-END:][::-1])
        return {x for e in ends for x in (e[:-1], e[:-2], *(e[:k] + e[k + 1 :] for k in range(1, END)))}
    keys = {code}
    if len(code) > (1 if register else 2):
        fewer = without_one(keys)
        keys |= fewer
        if len(code) > (3 if register else 5):
            keys |= without_one(fewer)
    return keys


def proper(words: list[str], reg: Register) -> list[str]:
    """The words that may be a name proper, as they sound; all words if there is none."""
    found = [w for w in words if w not in LEGAL and w not in JOINTS and w not in TITLES and len(w) > 1 and w not in reg.given and w not in reg.business]
    return sorted({spelt(w) for w in found or words} - {""})


def value_words(text: str, reg: Register) -> list[str]:
    """The words proper of all readings of a value."""
    whole, cuts = readings(text, reg)
    parts = {p for found in cuts.values() for cut in found for p in cut}
    return proper(sorted({w for r in whole for w in r} | parts), reg)


def name_words(text: str) -> list[str]:
    """The words of a name in order, without legal forms, forms of address and joints."""
    words = tokens(text)
    return sorted(w for w in words if w not in LEGAL and w not in JOINTS and w not in TITLES) or sorted(words)


def whole_keys(text: str) -> list[str]:
    """Codes of all words of a name together, in the order of the words' codes, and what is left of them with one sound left out."""
    code = " ".join(sorted(map(phonetic, name_words(text))))
    return sorted(lossy(code, False) if len(code) > 2 * END else {code, *without_one({code})})


def legal_form(text: str) -> str:
    """The legal forms in a name, in one spelling; empty if it has none."""
    same = {"limited": "ltd", "incorporated": "inc", "corporation": "corp", "slu": "sl", "sau": "sa", "company": "co"}
    return " ".join(sorted({same.get(w, w) for w in tokens(text) if w in LEGAL and w not in ("unipersonal",)}))


def alike(a: str, b: str, reg: Register) -> bool:
    """Whether two values are variants of one name: all words but one are equal as they sound, and that one is the same word with
    slips; two given names, or two lines of business, are the same only by the nickname table or the same line."""
    x, y = name_words(a), name_words(b)
    if len(x) != len(y):
        return False
    left = list(y)
    odd = []
    for w in x:
        same = next((v for v in left if v == w), None) or next((v for v in left if spelt(v) == spelt(w)), None)
        if same is None:
            odd.append(w)
        else:
            left.remove(same)
    if len(odd) != 1 or len(x) == 1:
        return not odd
    u, v = odd[0], left[0]
    if u in reg.nick or v in reg.nick or u in reg.given or v in reg.given:
        return bool(reg.nick.get(u, {u}) & reg.nick.get(v, {v}))
    if (lines := reg.business_of(u)) or reg.business_of(v):
        return lines == reg.business_of(v)
    return same_word(u, v) >= 0.88


Vocabulary = tuple[tuple[str, ...], tuple[str, ...]]


def alike_column(words: Vocabulary):
    @F.pandas_udf("boolean")
    def check(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        reg = vocabulary_of(*words)
        for a, b in batches:
            yield pd.Series([alike(x, y, reg) for x, y in zip(a, b)], dtype="bool")

    return check


READ = "struct<words:array<string>,legal:string,sounds:array<string>,codes:array<string>>"


def read_column(words: Vocabulary):
    """Of a name the words proper, the legal form, the sounds of all words, and the codes of all words together."""

    @F.pandas_udf(READ)
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reg = vocabulary_of(*words)
        for s in texts:
            rows = [(value_words(t, reg), legal_form(t), sorted({spelt(w) for w in name_words(t)}), whole_keys(t)) for t in s]
            yield pd.DataFrame(rows, columns=["words", "legal", "sounds", "codes"])

    return read


def codes_column(register: bool):
    return F.pandas_udf(lambda s: s.map(lambda w: sorted(lossy(phonetic(w), register))), "array<string>")


def fit_column(words: Vocabulary):
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        reg = vocabulary_of(*words)
        parties: dict[int, Party] = {}
        read: dict[str, tuple] = {}
        for forms, ids, names, kinds, cities in batches:
            out = []
            for form, i, name, kind, city in zip(forms, ids, names, kinds, cities):
                if i not in parties:
                    parties[i] = Party(i, name, kind, city, reg)
                if form not in read:
                    if len(read) > 50_000:
                        read.clear()
                    read[form] = readings(form, reg)
                out.append(fits(read[form], parties[i], reg))
            yield pd.Series(out, dtype="float64")

    return score


FIELDS = ("supplier_name", "customer_name")


def vocabulary(register: DataFrame) -> Vocabulary:
    """Lines of business and given names of the register: the words that at least COMMON parties share.

    At most a COMMON-th of all words of the register can come out.
    """
    split: Callable = F.pandas_udf(lambda s: s.map(lambda t: sorted(set(tokens(t)))), "array<string>")
    words = register.select("kind", F.explode(split("form")).alias("w")).groupBy("kind", "w").count()
    rows = words.where(F.col("count") >= COMMON).collect()
    business = [r["w"] for r in rows if r["kind"] != "person" and r["w"] not in LEGAL and r["w"] not in JOINTS and len(r["w"]) > 2]
    return tuple(sorted(business)), tuple(sorted(r["w"] for r in rows if r["kind"] == "person"))


def find(spark: SparkSession, extractions: DataFrame, parties: DataFrame) -> DataFrame:
    """``(extraction_id, field, party_id)``: names that mean a party of the register in another spelling.

    Distinct values are brought to one form, blocked with the register by phonetic codes (an equality join: a block has as
    many rows as values and parties share a code, and the register is fixed), and compared word by word with Jaro-Winkler and
    the nickname table; a value is linked to its best party, and to none if two fit equally well. Values that no party fits are compared
    with the linked ones, blocked by the codes of all their words, until no more links are found. The links are clustered by
    connected components; a value goes to its own party, or to that of its component if it has just one. Null and empty values, and values that
    are a registered name, come to nothing; rows delivered again come out once; empty tables give an empty result.
    """
    stages = Stages(spark)
    ship_code(spark)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").alias("value")) for f in FIELDS])
    rows = extractions.where("extraction_id is not null").select("extraction_id", F.inline(each)).where("trim(value) <> ''")
    register = parties.where("party_id is not null and trim(name) <> ''").select("party_id", "name", "kind", "city")
    # Exact names go first: the most frequent values are among them.
    exact = register.select(F.col("name").alias("value"))
    rows = rows.join(F.broadcast(exact) if is_small(exact) else exact, "value", "left_anti")
    values = stages.cut(rows.groupBy("value").agg(F.count("*").alias("n")))
    texts = values.select("value").union(register.select("name"))
    rewrite = rewrite_column(spark, representatives(code_point_counts(texts, "value")))
    register = stages.cut(register.withColumn("form", rewrite("name")))
    args = vocabulary(register)
    read, score, check = read_column(args), fit_column(args), alike_column(args)
    forms = stages.cut(spread(values).withColumn("form", rewrite("value")), values)
    distinct = stages.cut(spread(stages.cut(forms.select("form").distinct())).withColumn("r", read("form")).select("form", "r.*"))
    known = stages.cut(register.select("*", F.explode(read("form")["words"]).alias("party_word")).withColumnRenamed("form", "party_form"))
    # Words are compared once, however many values and parties have them.
    asked = distinct.select("form", F.explode("words").alias("word"))
    words = stages.cut(asked.groupBy("word").agg(F.count("*").alias("n")))
    coded = spread(words).select("word", F.explode(codes_column(False)("word")).alias("key"))
    theirs = stages.cut(known.select("party_word").distinct().select("party_word", F.explode(codes_column(True)("party_word")).alias("key")))
    # A swap of letters is two changes to this plain distance, so twice the edits that are allowed may be one word.
    n = F.least(F.length("word"), F.length("party_word"))
    near = F.when(n < 3, 1).when(n < 5, 2).when(n < 9, 4).otherwise(6)
    alike_words = (
        coded.join(F.broadcast(theirs) if is_small(theirs, REGISTER_KEYS) else theirs, "key").where(F.levenshtein("word", "party_word", 6).between(0, near))
        .groupBy("word").agg(F.collect_set("party_word").alias("party_words"))  # at most the words of the register
        .join(words, "word")
    )
    touched = with_value(asked, stages.cut(alike_words), "word", "n").select("form", F.explode("party_words").alias("party_word"))
    pairs = (
        touched.join(F.broadcast(known) if is_small(known) else known, "party_word")
        .select("form", "party_id", "party_form", "kind", "city")
        .distinct()
    )
    # The pairs of a value stay together, for it is read once. A filter on the score would be pushed below that, so it comes after.
    pairs = spread(stages.cut(pairs), "form")
    scored = stages.cut(pairs.withColumn("s", score("form", "party_id", "party_form", "kind", "city"))).where("s > 0")
    best = scored.groupBy("form").agg(F.max(F.struct("s", "party_id")).alias("b"), F.collect_set(F.struct("s", "party_id")).alias("all"))  # at most as many as parties
    single = best.where(F.size(F.filter("all", lambda x: x["s"] == F.col("b.s"))) == 1)
    named = stages.cut(single.select("form", "b.party_id"))
    # Values that no party fits, against those that have one.
    legal = F.pandas_udf(lambda s: s.map(legal_form), "string")
    owners = register.select("party_id", legal("form").alias("owner_legal"))
    told = distinct.select("form", "legal", "sounds", "codes")
    rest = stages.cut(told.join(scored.select("form").distinct(), "form", "left_anti"))
    target, links = named.join(F.broadcast(owners) if is_small(owners) else owners, "party_id").select("form", "owner_legal"), []
    while True:
        other = told.join(target, "form").select(F.col("form").alias("linked"), F.col("sounds").alias("linked_sounds"), "owner_legal", F.explode("codes").alias("key"))
        # Another legal form is another company; more than one other word is another name.
        agree = (F.col("legal") == "") | (F.col("owner_legal") == "") | (F.col("legal") == F.col("owner_legal"))
        close = F.size(F.array_except("sounds", "linked_sounds")) <= 1
        tried = rest.select("form", "legal", "sounds", F.explode("codes").alias("key")).join(other, "key").where(agree & close).select("form", "linked", "owner_legal").distinct()
        found = stages.cut(spread(stages.cut(tried), "form").withColumn("ok", check("form", "linked"))).where("ok").drop("ok")
        if found.isEmpty():
            break
        links.append(found)
        target = stages.cut(found.select("form", "owner_legal").distinct())
        rest = stages.cut(rest.join(target.select("form"), "form", "left_anti"), rest)
    value = lambda c: F.concat(F.lit("v:"), c)
    edges = named.select(value("form").alias("a"), F.concat(F.lit("p:"), "party_id").alias("b"))
    for more in links:
        edges = edges.union(more.select(value("form"), value("linked")))
    comps = components(spark, edges, stages)
    parties_of = comps.where("node like 'p:%'").groupBy("comp").agg(F.count("*").alias("parties"), F.min(F.substring("node", 3, 30).cast("bigint")).alias("one"))
    sized = comps.groupBy("comp").agg(F.count("*").alias("members")).join(parties_of, "comp")
    members = with_value(comps.where("node like 'v:%'"), stages.cut(sized), "comp", "members").select(F.expr("substring(node, 3)").alias("form"), "parties", "one")
    decided = members.join(named, "form", "left").select("form", F.coalesce("party_id", F.when(F.col("parties") == 1, F.col("one"))).alias("party_id")).where("party_id is not null")
    answer = stages.cut(forms.join(decided, "form").select("value", "n", "party_id"))
    return with_value(rows, answer, "value", "n").select("extraction_id", "field", "party_id").distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier and customer names that name a registered party without being its registered name."""
    return find(spark, table(spark, folder, "extractions"), table(spark, folder, "parties"))
