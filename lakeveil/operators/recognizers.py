"""Recognizers: a pattern, what may not stand beside it, a check, words near it that raise its score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lakeveil.functions import checks
from lakeveil.functions.spans import clear_of_marks, find_spans, marked, not_after, once, quoted, spans_sql

FOUND = "array<struct<start:int,end:int,entity_type:string,text:string,score:double,recognizer:string,ner:boolean,source:string,active:boolean>>"
#: Words before a hit that are searched for context, the characters that hold them, and what one of them adds.
CONTEXT_WORDS, CONTEXT_CHARS, CONTEXT_BOOST, CONTEXT_LEAST = 5, 300, 0.35, 0.4


def finding(start, end, entity_type, text, score, recognizer, ner=False, source="auto", active=True) -> Column:
    """One element of FOUND."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = dict(start=start, end=end, entity_type=entity_type, text=text, score=score, recognizer=recognizer, ner=ner, source=source, active=active)
    return F.struct(*[as_col(v).alias(k) for k, v in values.items()])


@dataclass(frozen=True)
class Recognizer:
    name: str
    entity_type: str
    pattern: str
    score: float
    group: bool = False
    before: str | None = None
    after: str | None = None
    check: Callable[[Column], Column] | None = None
    reject: str | None = None
    context: tuple[str, ...] = field(default=())
    #: reads the case of letters, so it runs again on capitals brought to title case
    case_bound: bool = False

    #: further test of the text of a hit that does not make it certain
    accept: Callable[[Column], Column] | None = None
    #: a text without any of these has no match; neither has one without a figure, if ``figures``
    needs: tuple[str, ...] = ()
    figures: bool = True
    #: what every match holds, as a pattern. A recognizer with it is searched for in the pieces of a text that hold it, so no
    #: match may go over the end of a piece; one without it is searched for in the whole text
    told: str | None = None

    def needed(self, text: str, figures: str) -> Column | None:
        """Whether a text can have a match, by plain searches; ``figures``: the column that says whether it has one."""
        tests = [f"({' OR '.join(f'contains({text}, {quoted(n)})' for n in self.needs)})"] if self.needs else []
        tests += [figures] if self.figures else []
        return F.expr(" AND ".join(tests)) if tests else None

    def spans(self, parts: str, text: str, told: str) -> Column:
        """Spans of the pattern, cut out of the pieces ``told`` as ``parts``, at their places in the whole text, that pass all tests."""
        tests = ["true"]
        if self.before:
            tests.append(f"NOT (CASE WHEN s.start > 0 THEN substring({text}, s.start, 1) ELSE '' END RLIKE {quoted(self.before)})")
        if self.after:
            tests.append(f"NOT (substring({text}, s.`end` + 1, 1) RLIKE {quoted(self.after)})")
        if self.reject:
            tests.append(f"NOT (s.text RLIKE {quoted(self.reject)})")
        shift = f"element_at(filter({told}, p -> p.at <= s.start), -1).shift"
        placed = f"transform(transform({spans_sql(parts)}, s -> named_struct('s', s, 'by', {shift})), x -> named_struct('start', x.s.start + x.by, 'end', x.s.`end` + x.by, 'text', x.s.text))"
        out = F.expr(f"filter({placed}, s -> {' AND '.join(tests)})")
        if self.accept:
            out = F.filter(out, lambda s: self.accept(s.text))
        if self.check:
            out = F.filter(out, lambda s: self.check(s.text))
        return out

    def hits(self, spans: str, text: str, threshold: float) -> str:
        """FOUND, as SQL text, of such spans whose score reaches ``threshold``. A passed check makes a hit certain."""
        score = f"{1.0 if self.check else self.score}D"
        if self.context:
            # a word that the window cuts is one too many, or not among the last five
            head = f"lower(substring({text}, greatest(s.start - {CONTEXT_CHARS - 1}, 1), least(s.start, {CONTEXT_CHARS})))"
            head = f"CASE WHEN s.start > {CONTEXT_CHARS} THEN regexp_replace({head}, {quoted(r'^[\p{L}\p{N}]+')}, '') ELSE {head} END"
            words = f"reverse(filter(split({head}, {quoted(r'[^\p{L}\p{N}]+')}), w -> w <> ''))"
            near = f"arrays_overlap(slice({words}, 1, {CONTEXT_WORDS}), array({', '.join(map(quoted, self.context))}))"
            score = f"CASE WHEN {near} THEN least(greatest({score} + {CONTEXT_BOOST}D, {CONTEXT_LEAST}D), 1.0D) ELSE {score} END"
        found = f"named_struct('start', s.start, 'end', s.`end`, 'entity_type', {quoted(self.entity_type)}, 'text', s.text, 'score', bround({score}, 2), 'recognizer', {quoted(self.name)}, 'ner', false, 'source', 'auto', 'active', true)"
        return f"filter(transform({spans}, s -> {found}), f -> f.score >= {threshold}D)"


_DIGIT, _WORD = "[0-9]", r"[\p{L}\p{N}_]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:(?:19|20)[0-9]{2}|[0-9]{2})"
#: German month names.
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_DATE_WORDS = ("geboren", "geb", "geburtsdatum", "geburtstag", "gestorben", "verstorben", "born", "birth")

#: What German street names end in: ways, then squares, then what a street runs along.
STREET_KINDS = (
    "straße strasse str. weg allee gasse gässchen chaussee pfad steig stieg steg twiete zeile promenade damm"
    " platz markt ring rondell anger hof"
    " ufer kai deich brücke tor wall graben berg hang park garten winkel siedlung"
).split()
_KIND = "|".join(k.replace(".", r"\.") for k in STREET_KINDS)
#: A house number as DIN 5008 writes it: figures and a letter; several are joined by a dash, a slash or a plus.
_HOUSE_PART = r"[1-9][0-9]{0,3}(?:\h?[A-Za-z](?!\w))?"
_HOUSE = rf"{_HOUSE_PART}(?:\h?[-–/+]\h?{_HOUSE_PART})*"
#: A proper name: parts with a capital, joined by hyphens.
_PART = r"\p{Lu}[\p{Ll}’']+"
_PROPER = rf"{_PART}(?:-{_PART})*"
#: Prepositions that street names begin with; the longer ones take an article.
_OPENING = r"(?:Am|Beim|Im|Vom|Zum|Zur|(?:An|Auf|Bei|Hinter|In|Neben|Unter|Vor|Zu|Zwischen)\h(?:dem|den|der|das))"
#: What is counted after a number of five figures, so that the number is no postcode.
COUNTED = set(
    "euro eur dollar franken cent mark prozent meter kilometer quadratmeter kubikmeter hektar gramm kilogramm tonnen liter watt volt"
    " stück exemplare einheiten punkte plätze sitze menschen personen leute einwohner einwohnerinnen bürger mitglieder besucher teilnehmer zuschauer"
    " jahre monate wochen tage stunden minuten sekunden uhr mal aktien wohnungen fahrzeuge dateien seiten zeichen wörter".split()
)
#: Words for offices and callings; after a form of address they are no name.
CALLINGS = (
    "doktor professor direktor rektor präsident kanzler minister staatssekretär bürgermeister landrat stadtrat richter staatsanwalt anwalt rechtsanwalt notar"
    " pfarrer bischof pastor lehrer schulleiter leiter vorsitzender vorstand geschäftsführer kollege nachbar doktorand ingenieur hausmeister oberarzt chefarzt arzt".split()
)


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"\h+")


def _street_ends(whole: bool) -> Callable[[Column], Column]:
    """Whether the word before the house number is (``whole``) or ends in a kind of street."""
    edge = "(?:^|\\h)" if whole else "(?:[\\p{L}-])"
    return lambda text: F.lower(text).rlike(rf"{edge}(?:{_KIND})\h+[0-9][^\p{{L}}]*(?:[a-z]\b[^\p{{L}}]*)*$")


def _town_word(text: Column) -> Column:
    return ~F.coalesce(F.try_element_at(_words(text), F.lit(2)).isin(*COUNTED), F.lit(False))


#: Also for women, and in the other cases.
_CALLED = sorted({x for c in CALLINGS for x in (c, c + "in", c.removesuffix("e") + "in", c + "n", c.removesuffix("er") + "e")})


def _not_calling(text: Column) -> Column:
    return ~F.try_element_at(_words(text), F.lit(1)).isin(*_CALLED)


#: Degrees that may follow a form of address, and all that may open a titled name.
_DEGREE = r"(?:Dr|Prof|Mag|Dipl\.-Ing|Ing|med|phil|jur|rer|nat|habil|dent|vet|h\.\h?c)\."
_TITLE = rf"(?:Herrn?|Frau|Hr\.|Fr\.|Familie|{_DEGREE})"
#: The same, with what is rare first.
_TITLED = r"\.\h(?<=(?:Hr|Fr|Dr|Prof|Mag|Ing|med|phil|jur|rer|nat|habil|dent|vet|h\.\h?c)\.\h)|Herr|Frau|Familie"

RECOGNIZERS = [
    Recognizer("email", "EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, needs=("@",), figures=False, told="@"),
    Recognizer("ipv4", "IP_ADDRESS", rf"{_OCTET}(?:\.{_OCTET}){{3}}", 0.6, before="[0-9.]", after="[0-9]", needs=(".",), told=_DIGIT),
    Recognizer("ipv6", "IP_ADDRESS", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}", 0.6, before="[0-9A-Za-z:]", after="[0-9A-Za-z:]", needs=(":",), figures=False, told="[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    Recognizer("card", "CREDIT_CARD", r"[0-9](?:[ -]?[0-9]){11,18}", 1.0, before=_DIGIT, after=_DIGIT, check=checks.luhn, told=_DIGIT),
    Recognizer("phone_us", "PHONE_NUMBER", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.55, after=_DIGIT, needs=("+1 (",), told=_DIGIT),
    Recognizer("phone_de", "PHONE_NUMBER", r"(?:(?:\+|00)(?:49|43|41)[ ]?(?:\(0\))?|\(?0)[1-9][0-9]{1,4}\)?(?:[ /-]{0,3}[0-9]){4,9}", 0.55, before=r"[0-9+.]", after=_DIGIT, reject=r"^[0-9]+\.[0-9]+\.[0-9]", context=("telefon", "tel", "mobil", "handy", "fax", "phone"), told=_DIGIT),
    Recognizer("secret", "SECRET", r'token = "[0-9a-f]{32,64}"', 0.9, needs=('token = "',), figures=False, told='token = "'),
    Recognizer("url", "URL", r"(?:https?://|www\.)[^\s<>\"']+[^\s<>\"'.,;:!?)]", 0.6, needs=("http", "www."), figures=False, told=r"https?://|www\."),
    Recognizer("iban", "IBAN_CODE", r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?", 1.0, before=_WORD, after=_WORD, check=checks.iban, told=_DIGIT),
    Recognizer("street", "DE_ADDRESS", rf"\p{{Lu}}[\p{{L}}-]*\.?\h{{1,2}}{_HOUSE}", 0.65, before=_WORD, after=_WORD, accept=_street_ends(False), case_bound=True, told=_DIGIT),
    Recognizer("street_two_words", "DE_ADDRESS", rf"{_PART}\h\p{{L}}+\.?\h{{1,2}}{_HOUSE}", 0.65, before=_WORD, after=_WORD, accept=lambda t: _street_ends(True)(t) & t.rlike(r"^\S+(?:er|e|en|es)\h"), reject=r"^(?i:(?:d|jed|dies|jen|welch)(?:er|en|es|e)|(?:k?ein|mein|dein|sein|ihr|unser|euer)(?:er|en|es|e)?)\h", case_bound=True, told=_DIGIT),
    Recognizer("street_by_preposition", "DE_ADDRESS", rf"{_OPENING}\h{_PROPER}\h{_HOUSE}", 0.3, before=_WORD, after=_WORD, context=("adresse", "anschrift", "wohnhaft", "wohnt", "straße", "address"), case_bound=True, told=_DIGIT),
    Recognizer("po_box", "DE_ADDRESS", r"(?iu:postfach)\h+[0-9]{1,2}(?:\h?[0-9]{2}){0,4}", 0.6, before=_WORD, after=_DIGIT, told=_DIGIT),
    Recognizer("town", "DE_ADDRESS", rf"[0-9]{{5}}\h(?:(?:Bad|Sankt|St\.|Markt|Groß|Klein)\h)?{_PROPER}(?:\h(?:(?:an?|ob|unter|vor)\h(?:de[mnr]|d\.)|am|im|in|bei|a\.)\h{_PROPER}|/{_PART})?", 0.55, before=r"[0-9.,]", after=_WORD, accept=_town_word, case_bound=True, told=_DIGIT),
    Recognizer("date", "DATE_TIME", rf"{_DAY}\.[ ]?{_MONTH}\.[ ]?{_YEAR}", 0.3, before="[0-9.]", after=r"[0-9]", context=_DATE_WORDS, told=_DIGIT),
    Recognizer("date_long", "DATE_TIME", rf"{_DAY}\.[ ](?:{MONTHS})[ ](?:19|20)[0-9]{{2}}", 0.3, before=_DIGIT, after=_DIGIT, context=_DATE_WORDS, needs=tuple(MONTHS.split("|")), told=_DIGIT),
    Recognizer("date_iso", "DATE_TIME", r"(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])", 0.25, before="[0-9-]", after="[0-9-]", context=_DATE_WORDS, needs=("-",), told=_DIGIT),
    Recognizer("date_of_life", "DATE_TIME", rf"((?<![*_\p{{L}}\p{{N}}])[*†]\h?)({_DAY}\.[ ]?{_MONTH}\.[ ]?{_YEAR})(?![0-9*])", 0.6, group=True, needs=("*", "†"), told=_DIGIT),
    Recognizer("titled_name", "PERSON", rf"((?<!\p{{L}}){_TITLE}\h(?:{_DEGREE}\h)*)({_PROPER}(?:\h{_PROPER})?)", 0.6, group=True, accept=_not_calling, case_bound=True, figures=False, told=_TITLED),
    Recognizer("pension", "DE_SOCIAL_SECURITY", r"[0-9]{2}[ ]?[0-9]{6}[ ]?[A-Z][ ]?[0-9]{2}[ ]?[0-9]", 0.5, before=_WORD, after=_WORD, check=checks.pension_number, told=_DIGIT),
    Recognizer("health", "DE_HEALTH_INSURANCE", r"[A-Z][0-9]{9}", 0.5, before=_WORD, after=_WORD, check=checks.health_number, told=_DIGIT),
    Recognizer("tax_id", "DE_TAX_ID", r"[1-9][0-9](?:[ ]?[0-9]{3}){3}", 0.5, before=_WORD, after=_WORD, check=checks.tax_id, told=_DIGIT),
    Recognizer("tax_number", "DE_TAX_NUMBER", r"[0-9]{2,3}/[0-9]{3,4}/[0-9]{4,5}", 0.4, before="[0-9/]", after="[0-9/]", context=("steuernummer", "steuer", "finanzamt", "tax"), needs=("/",), told=_DIGIT),
    Recognizer("vat_id", "DE_VAT_ID", r"DE[ ]?[0-9]{9}", 0.5, before=_WORD, after=_WORD, check=checks.vat_id, needs=("DE",), told=_DIGIT),
    Recognizer("id_card", "DE_ID_CARD", r"[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}[0-9]", 0.5, before=_WORD, after=_WORD, check=checks.document_number, told=_DIGIT),
    Recognizer("passport", "DE_PASSPORT", r"[CFGHJK][CFGHJKLMNPRTVWXYZ0-9]{8}", 0.3, before=_WORD, after=_WORD, reject="^[A-Z]+$", context=("reisepass", "pass", "passnummer", "passport"), told=_DIGIT),
    Recognizer("licence", "DE_FUEHRERSCHEIN", r"[A-Z0-9][0-9]{2}[A-Z0-9]{6}[0-9][A-Z0-9]", 0.3, before=_WORD, after=_WORD, context=("führerschein", "führerscheinnummer", "fahrerlaubnis"), told=_DIGIT),
    Recognizer("plate", "DE_KFZ", r"[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}[ ]?[1-9][0-9]{0,3}[EH]?", 0.5, before=_WORD, after=_WORD, needs=("-",), told=_DIGIT),
    Recognizer("postcode", "DE_PLZ", r"[0-9]{5}", 0.1, before="[0-9.,-]", after="[0-9.,-]", context=("plz", "postleitzahl"), told=_DIGIT),
    Recognizer("register", "DE_HANDELSREGISTER", r"HR[AB][ ]?[0-9]{1,6}[ ]?[A-Z]?", 0.6, before=_WORD, after=_WORD, needs=("HRA", "HRB"), told=_DIGIT),
    Recognizer("physician", "DE_LANR", r"[0-9]{9}", 0.1, before=_DIGIT, after=_DIGIT, context=("lanr", "arztnummer"), told=_DIGIT),
    Recognizer("practice", "DE_BSNR", r"[0-9]{9}", 0.1, before=_DIGIT, after=_DIGIT, context=("bsnr", "betriebsstättennummer"), told=_DIGIT),
]
BY_NAME = {r.name: r for r in RECOGNIZERS}

#: Where texts are cut into pieces: at line ends, and at signs that part clauses, before a blank.
_CUT = r"(?<=[ \n])(?<=\n|[,;!?] )"
#: Pieces of a text that are put together one by one; a text in which more of them tell of matches is searched whole.
MOST_PIECES = 256


def _cut(text: str, told: str | None) -> Column:
    """A text as pieces: their texts, sizes, and whether they match ``told``; null and empty texts have none. Without ``told`` a
    text is one piece."""
    clear = F.when(F.length(F.col(text)) > 0, clear_of_marks(F.col(text)))
    pieces = F.coalesce(F.split(clear, F.lit(_CUT), -1) if told else F.when(clear.isNotNull(), F.array(clear)), F.array().cast("array<string>"))
    return F.transform(pieces, lambda p: F.struct(p.alias("text"), F.length(p).alias("n"), (p.rlike(told) if told else F.lit(True)).alias("told")))


def _telling(cut: str, idx: str) -> Column:
    """The pieces ``idx`` of those of ``cut``: their texts, sizes, and the characters between each and the one before it."""
    before = f"IF(j = 0, 0, element_at({idx}, greatest(j, 1)) + 1)"
    gap = f"aggregate(slice({cut}, {before} + 1, k - {before}), 0, (a, p) -> a + p.n)"
    return F.expr(f"transform({idx}, (k, j) -> named_struct('text', element_at({cut}, k + 1).text, 'n', element_at({cut}, k + 1).n, 'gap', {gap}))")


def _places(pieces: str) -> Column:
    """Places of the pieces of ``_telling`` in the text that they make, joined by line ends, and how far that is from the whole."""
    # only numbers go through the fold, which copies its state at each step
    step = "named_struct('from', s.from + p.gap + p.n, 'at', s.at + p.n + 1, 'found', concat(s.found, array(named_struct('at', s.at, 'shift', s.from + p.gap - s.at))))"
    return F.expr(f"aggregate({pieces}, named_struct('from', 0, 'at', 0, 'found', cast(array() AS array<struct<at:int,shift:int>>)), (s, p) -> {step}, s -> s.found)")


def recognized(df: DataFrame, text: str, entities: list[str], threshold: float = 0.45, only: Callable[[Recognizer], bool] = lambda r: True, into: str = "findings") -> DataFrame:
    """``df`` with the hits of all recognizers of the kinds asked for in one array: one pass over a row, no scan for each
    recognizer, and each pattern in the plan once. A null text has none."""
    own = [r for r in RECOGNIZERS if r.entity_type in entities and only(r)]
    if not own:
        return df.withColumn(into, F.array().cast(FOUND))
    t = f"`{text}`"
    # the pieces without a sign of any match, most of a text, are left out before the patterns are searched for
    tells = None if any(r.told is None for r in own) else "|".join(dict.fromkeys(r.told for r in own))
    out = once(df, __cut=_cut(t, tells))
    out = once(out, __idx=F.expr("filter(transform(__cut, (p, i) -> IF(p.told, i, -1)), i -> i >= 0)"))
    whole = F.expr("array(named_struct('text', array_join(transform(__cut, p -> p.text), ''), 'n', 0, 'gap', 0))")
    out = once(out, __pieces=F.when(F.size("__idx") > MOST_PIECES, whole).otherwise(_telling("__cut", "__idx"))).drop("__cut", "__idx")
    out = once(out, __clear=F.array_join(F.transform("__pieces", lambda p: p.text), "\n"), __told=_places("__pieces")).drop("__pieces")
    out = once(out, __figures=F.col("__clear").rlike("[0-9]"))
    marks = F.when(F.length("__clear") > 0, F.struct(*[marked("__clear", r.pattern, r.group, r.needed("__clear", "__figures")).alias(r.name) for r in own]))
    out = once(out, __marks=marks).drop("__clear", "__figures")
    out = once(out, __spans=F.when(F.col("__marks").isNotNull(), F.struct(*[r.spans(f"__marks.{r.name}", t, "__told").alias(r.name) for r in own]))).drop("__marks", "__told")
    hits = ", ".join(r.hits(f"__spans.{r.name}", t, threshold) for r in own)
    return once(out, **{into: F.expr(f"CASE WHEN __spans IS NOT NULL THEN flatten(array({hits})) ELSE cast(array() AS {FOUND}) END")}).drop("__spans")


def find_terms(text: Column | str, terms: list[str], entity_type: str = "CUSTOM", any_case: bool = True, ner: bool = False, score: float = 1.0) -> Column:
    """Literal terms, not inside a word. The terms are a setting: they make one pattern."""
    terms = sorted({t.strip() for t in terms if t and t.strip()}, key=lambda t: (-len(t), t))
    if not terms:
        return F.array().cast(FOUND)
    body = "|".join(r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in terms)
    flags = "(?iu)" if any_case else ""
    return F.transform(find_spans(text, rf"{flags}{not_after(r'\p{L}\p{N}_')}(?:{body})(?![\p{{L}}\p{{N}}_])"), lambda s: finding(s.start, s.end, entity_type, s.text, score, "names" if ner else "terms", ner))


def dictionary_names(given: list[str], places: list[str], score: float = 0.85) -> Callable[[Column], Column]:
    """A name model from lists: given names, with the capitalised words after them, are persons; places are places. For
    ``Settings.names`` where no statistical model is at hand."""
    quoted = lambda words: "|".join(r"\Q" + w + r"\E" for w in sorted(set(words), key=lambda w: (-len(w), w)))

    def names(text: Column) -> Column:
        out = [find_terms(text, places, "LOCATION", any_case=False, ner=True, score=score)]
        if given:
            spans = find_spans(text, rf"(?<![\p{{L}}\p{{N}}_-])(?:{quoted(given)})(?![\p{{L}}\p{{N}}_])(?:[ -]{_PROPER}){{0,3}}")
            out.append(F.transform(spans, lambda s: finding(s.start, s.end, "PERSON", s.text, score, "names", True)))
        return F.concat(*out)

    return names
