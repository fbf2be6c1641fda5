"""Invented German texts with marked names, to fit a tagger on and to measure it by.

Words and sentences are fixed values, all made up for this purpose. Every third of each list is for measuring, the others
are for fitting, so what is measured are names and sentences that were never seen.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = "Anna Jonas Marta Felix Ingrid Paul Sofia Emil Katrin Anton Helga Lukas Petra Moritz Renate Jakob Silke Oskar Birgit Theo Monika Karl Astrid Leon Ursula Max Gudrun Noah Elke David Frieda Simon Carla Tobias Nina Ralf Vera Bernd Olga Uwe Mehmet Aylin Piotr Ewa Luca Giulia Amir Leila Ivan Irina".split()
SURNAMES = "Brandner Hofstetter Kessler Lindemann Marquardt Neuhaus Oberländer Pfeiffer Quast Reinholz Schuster Tannert Uhlig Vollmer Wegener Zeidler Achterberg Bachmann Cordes Dressler Ehlers Fuhrmann Gerlach Hagedorn Imhoff Jansen Kowalski Lorenzen Mertens Nowak Ostermann Petersen Rademacher Sandmann Thiele Ullrich Voigt Wiesner Yildirim Zimmer Albers Bergmann Conrads Dorn Eckert Fromm Grabowski Hellwig Ivanov Jordan".split()
PLACES = "Altmühl Bergheim Cadenberge Dornstadt Eschwege Freudental Grünau Hohenfels Ilmenau Jüterbog Kaltenbach Lindau Marienthal Neuburg Oldenfelde Pirna Quedlinburg Rosenheim Seeheim Tiefenbach Uelzen Vilshofen Waldkirch Xanten Zwickau Aalen Buchholz Coburg Dinslaken Erkner Flensburg Görlitz Husum Itzehoe Jena Kassel Lübeck Münster Nürnberg Osnabrück Passau Rheine Soest Trier Ulm Viersen Wismar Zeitz Bremen Dresden".split()
#: {p}: given name and surname, {s}: surname, {g}: given name, {o}: place.
SENTENCES = [
    "{p} wohnt seit dem Frühjahr in {o}.",
    "Gestern hat Frau {s} den Antrag aus {o} geprüft.",
    "Der Bescheid geht an {p}, wohnhaft in {o}.",
    "Nach Angaben von {p} war die Rechnung bezahlt.",
    "Herr {s} und Frau {s} fahren am Montag nach {o}.",
    "Liebe {g}, vielen Dank für die Unterlagen aus {o}.",
    "Zur Sitzung in {o} kamen {p}, {p} und {p}.",
    "Mit freundlichen Grüßen\n{p}",
    "Die Bürgermeisterin {p} begrüßte die Gäste aus {o}.",
    "Im Protokoll steht, dass {s} den Vertrag nicht kannte.",
    "Unser Kollege {g} {s} ist ab Mai in {o} tätig.",
    "Anwesend: {p} (Leitung), {p}, Protokoll: {s}",
    "Bei {s} in {o} brannte am Abend ein Schuppen.",
    "Das Gespräch mit {p} fand in der Schule statt.",
    "{g} hat angerufen und fragt nach dem Termin.",
    "Die Firma zog von {o} nach {o} um.",
    "Sehr geehrte Frau {s},",
    "Dr. {s} untersuchte den Patienten {p} am Vormittag.",
    "In {o} wurde die neue Brücke eröffnet.",
    "Hallo {g}, kannst du {s} bitte Bescheid geben?",
    "Zeugin {p} sagte, sie habe {s} nie gesehen.",
    "Das Amt {o} schrieb am Freitag an {p}.",
    "Familie {s} sucht eine Wohnung nahe {o}.",
    "Die Klage von {p} gegen die Stadt {o} ist eingegangen.",
    "Wir treffen {g} und {g} am Bahnhof {o}.",
    "Verfasst von {p}, geprüft von {s}.",
    "Der Zug nach {o} hält heute nicht in {o}.",
    "Ansprechpartnerin ist {p}, Telefon im Anhang.",
    "{s} lehnte das Angebot ab, {p} nahm es an.",
    "Aus {o} berichtet unsere Mitarbeiterin {p}.",
]
#: For fitting only: what else stands beside names and places.
MORE = [
    "Die Stadt {o} hat den Plan beschlossen.",
    "Der Landkreis {o} zahlt die Hälfte.",
    "In der Gemeinde {o} leben weniger Menschen als in {o}.",
    "Dr. {p} operierte am Nachmittag.",
    "Prof. Dr. {s} hielt den Vortrag in {o}.",
    "Der Bürgermeister {s} und die Lehrerin {p} unterschrieben.",
    "{p} sagte, er habe {s} angerufen.",
    "Er habe {p} am Abend gesehen, so {s}.",
    "Aus {o} kommt die Meldung, dass {s} gewonnen hat.",
    "{g} schreibt, dass {g} krank ist.",
    "{s} war am Dienstag in {o} und {o}.",
    "Vertreten durch: {p}, {o}",
    "Die Nachbarin {s} hat den Schlüssel von {g}.",
    "Von {o} über {o} nach {o} sind es drei Stunden.",
    "Teilnehmer: {s}, {s}, {p}",
    "Antragsteller {p}, geboren in {o}",
]
PLAIN = [
    "Der Antrag wurde im Rahmen der Prüfung abgelehnt.",
    "Die Rechnung liegt dem Schreiben als Anlage bei.",
    "Am Montag beginnt die Sitzung um neun Uhr im großen Saal.",
    "Bitte senden Sie die Unterlagen bis Ende des Monats zurück.",
    "Das Protokoll der letzten Sitzung ist genehmigt.",
    "Nach dem Gesetz besteht kein Anspruch auf Erstattung.",
    "Im Winter bleibt das Büro an Feiertagen geschlossen.",
    "Die Leitung des Hauses dankt allen Gästen für den Besuch.",
    "Für Fragen zum Vertrag steht die Abteilung gern bereit.",
    "Eine Kopie des Ausweises ist nicht nötig.",
    "Die Kosten für Strom und Wasser sind gestiegen.",
    "Mit dem Umbau der Schule wird im Herbst begonnen.",
    "Sehr geehrte Damen und Herren,",
    "Mit freundlichen Grüßen\nDie Verwaltung",
    "Der Zug hält heute nicht am Hauptbahnhof.",
    "Zeugen werden gebeten, sich bei der Polizei zu melden.",
    "Unser Angebot gilt bis zum Ende der Woche.",
    "Das Gericht hat die Klage zugelassen.",
]
_SLOT = re.compile(r"\{([psgo])\}")


def share(words: list[str], held_out: bool) -> list[str]:
    return [w for i, w in enumerate(words) if (i % 3 == 2) == held_out]


def filled(rng: random.Random, sentence: str, held_out: bool) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence with names in its places, and their marks."""
    pick = lambda words: rng.choice(share(words, held_out))
    text, marks, at = "", [], 0
    for m in _SLOT.finditer(sentence):
        text += sentence[at : m.start()]
        name = {"p": lambda: f"{pick(GIVEN)} {pick(SURNAMES)}", "s": lambda: pick(SURNAMES), "g": lambda: pick(GIVEN), "o": lambda: pick(PLACES)}[m[1]]()
        marks.append((len(text), len(text) + len(name), "LOCATION" if m[1] == "o" else "PERSON"))
        text, at = text + name, m.end()
    return text + sentence[at:], marks


def marked_texts(count: int, held_out: bool = False, seed: int = 0) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` texts of one to six sentences with their marks; ``held_out``: those to measure by."""
    rng, out = random.Random(f"{seed}/{held_out}"), []
    for _ in range(count):
        text, marks = "", []
        for _ in range(rng.randint(1, 6)):
            more, own = filled(rng, rng.choice(share(SENTENCES, held_out) + ([] if held_out else MORE)), held_out) if rng.random() < 0.65 else (rng.choice(share(PLAIN, held_out)), [])
            text += "" if not text else rng.choice([" ", "\n", "\n\n"])
            marks += [(a + len(text), b + len(text), k) for a, b, k in own]
            text += more
        out.append((text, marks))
    return out


def marked_table(spark: SparkSession, count: int, held_out: bool = False, seed: int = 0) -> DataFrame:
    """The same as rows (doc_id, text, marks)."""
    rows = [(i, text, marks) for i, (text, marks) in enumerate(marked_texts(count, held_out, seed))]
    return spark.createDataFrame(rows, "doc_id long, text string, marks array<struct<start:int,end:int,entity_type:string>>")
