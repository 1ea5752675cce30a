"""A small labelled table for personal information in press text.

Each line is a sentence in which ``{..}`` marks what is personal; the lines are
filled with invented particulars by a fixed rule, so the table is small, free of
real data, and the same on every run.  ``{N}`` is a person, ``{E}`` an email
address, ``{P}`` a phone number, ``{I}`` a nine-digit number, ``{A}`` a street
address, ``{Y}`` an address behind a unit; ``<L>`` is a place, ``<O>`` a body,
``<W>`` a capitalised first word, ``<D>`` a number, ``<R>`` a shorter reference number, ``<M>`` a month and ``<T>`` a street sign.
"""

from __future__ import annotations

import random

# Labelled sentences.
SENTENCES = """
<W> growers rebuilt the dam , " said {N} , a baker .
<W> crews left , according to {N} , an engineer .
<W> boats sank by <D> , Dr. {N} told reporters . <W> roads closed .
Dr. {N} told readers that <W> levies fell near <L> .
{N} , a poet , warned : " The <O> paid <D> per cent .
<W> dikes held . {N} , a beekeeper , warned : " <W> dikes near <L> held .
<W> dikes held . {N} lives at {A} . Claimant {N} , SIN {I} .
<W> dikes held . {N} can be reached at {E} . {N} answers at {P} .
" The <O> rebuilt <L> , " said {N} , a surveyor . {N} lost the barn in the storm .
{N} lives at {A} with two dogs . <W> banks rose .
{N} answers at {P} on weekdays . <W> fields dried .
{N} answers at {P} , ext. <D> on weekdays
{N} can be reached at {E} . <W> mills closed .
{N} lost the shed in the flood . Near <L> , ferries sank .
Contact - {E} . The <O> met in <M> .
Contact - {N} ( {E} ; {P} ) . <W> towns paid .
Organiser : {N} ( {E} ; {P} ) . <W> towns paid .
Organiser : Mr. {N} ( {E} ; {P} )
{N} , {A} , {P} , {E} . <W> dairies failed .
{N} , {Y} , {P} , {E} . SIN : {I} . <W> dairies failed .
Ms. {N} , {A} , {P} , {E} . Across <L> , wells dried .
Claimant {N} , SIN {I} , of {A} . <W> herders waited .
Claimant Ms. {N} , SIN {I} , of {Y} . <W> herders waited .
SIN : {I} . <W> herders waited .
The form listed SIN {I} . <W> herders waited .
social insurance no. {I} appears on the file . In <L> , rain fell .
A claim showed {N} under number {I} . <W> dikes held .
social insurance no. {I} appears on the file . A claim showed {N} under number {I} . social insurance no. {I} appears on the file .
A claim showed {N} under number {I} . SIN : {I} . The form listed SIN {I} . Le dossier porte le numéro d' assurance sociale {I} .
The note was signed by {N} . The sheet listed {N} .
Letter to the editor from {N} . <W> parks reopened .
Witness list : {N} . Near <L> , <D> crews left .
By {N}
BY {N}
{N}
{N} . <W> dikes near <L> held .
{N} . <D> crews left . {N} . The <O> met .
Tel. : {P} . <D> crews left . SIN : {I} . The <O> met .
During <M> , crews left . During <M> , the <O> met .
Write to {E} . Readers can write to {E} before noon .
Tips : {E} . Contact - {E} . Courriel : {E} . Tips : {E} . <W> nets tore .
Contact - {E} . Contact - {E} . <W> nets tore . {N} can be reached at {E} .
Tips : {E} . Comments go to {E} before noon . <W> nets tore .
Phone {P} for details . Call {P} to register . <W> nets tore .
Call {P} to register . Composez le {P} pour vous inscrire .
The line ( {P} ) is open until dusk . Tel. : {P} . <W> nets tore .
The open house is at {A} . <W> nets tore .
Pumps emptied the basement of {A} twice . <W> nets tore .
Send your cheques to {A} . <W> nets tore .
« Les crues montent » , affirme {N} , boulangère . Les <W> ferment .
Les prix montent , selon Mme {N} . Les bateaux partent de <L> .
« Le gel dure » , affirme {N} , apiculteur . {N} , notaire , précise : « Les <W> ferment .
Les puits baissent . {N} habite au {A} . {N} a perdu son quai .
Les prix montent , explique M. {N} , de <L> .
{N} , romancière , prévient : « Selon l' <O> , <D> fermes ferment .
{N} habite au {A} depuis le gel . Les routes ferment .
{N} répond au {P} . Les routes ferment près de <L> .
{N} répond au {P} en semaine . {N} répond au {P} . Tél. : {P} .
{N} répond à l' adresse {E} . Les routes ferment .
{N} a perdu son quai . À <L> , les puits baissent .
Par {N}
PAR {N}
Réclamante : {N} , NAS {I} , {A} . Les usines ferment .
Réclamant : {N} , NAS {I} , {A}
Responsable : {N} ( {E} ; {P} ) . Les usines ferment .
{N} , {A} , {P} , {E} . Les usines ferment .
NAS : {I} . Le formulaire montrait le NAS {I} . Les usines ferment .
Le dossier porte le numéro d' assurance sociale {I} . Les usines ferment .
Une fuite associait {N} au numéro {I} . Les usines ferment .
On peut écrire à {E} . Vos commentaires : {E} . Les digues tiennent .
Composez le {P} pour vous inscrire . Tél. : {P} , poste <D> . Les digues tiennent .
La ligne ( {P} ) reste ouverte . Les digues tiennent à <L> .
La rencontre a lieu au {A} . Envoyez vos lettres au {A} . Les digues tiennent .
Lettre ouverte de {N} . Les digues tiennent .
La lettre porte la signature de {N} . Au large de <L> , les algues montent .
Near <L> , <D> crews of the <O> left <L> in <M> <D> .
At the <O> , <D> urban boats near <L> left in <D> of <D> districts .
By <M> <D> , the <O> and the <O> paid $ <D> million .
<W> levies near <L> fell <D> per cent . Outside <L> , <W> mills closed .
Between <L> and <L> , <W> barns burned . Since <D> , <L> waited .
The range <D> - <D> was cited on pages <D> - <R> .
Serial no. <R> was scratched off . Docket <R> was adjourned . Le dossier <R> est suspendu .
Station readings : <D> . <D> <D> . <D> <D> . <D> . Photo : archives .
Turn off <T> closures apply . With files from our newsroom . <W> parks reopened .
All rights reserved . Follow @ growers for updates . Suivez @ lecumoire .
Selon l' <O> , les fermes de <L> ferment . Dans la région de <L> , les prix montent .
Près de <L> , <D> familles partent . Le permis <R> expire en <M> <D> .
For <W> readers of the <L> Courier , The <L> Star and Le Quotidien , <M> was dry .
This article has been updated . Sign up for our letter . Photo credit : <L> archives .
"""

# Parts of invented names, places, bodies and addresses.
GIVEN = "Marek Liane Otto Bianca Corin Delphine Emeric Fabienne Goran Heloise Ilse Jonas Kirsi Léonie Maël Nerea Oscar Paloma Quentin Rémi Sibyl Théo Ulla Violette Wim Yannick Zelda Armand Beatriz Céline".split()
FAMILY_HEAD = "Tor Bel Gars Mont Krav Dess Pell Hév Lind Aub Mar Sol Var Rich Cast Dup Ner Oss Vald Jurg".split()
FAMILY_TAIL = "olotte ezny arsson iquin ugrel andry astad ucht ombert isker ivek andal isen owski ard eau ström ieri".split()
PLACE_HEAD = "Ash Bram Cold Dun East Fair Green Hart Iron Kings Long Mill Nor Oak Port Rock Stone Thorn West Wind".split()
PLACE_TAIL = "ville moor wick ford holm stead mouth dale burn ington".split()
PLACE_AFTER = " Falls| Harbour| Bay| Point| Landing".split("|") + [""] * 6
FRENCH_PLACE = "Sainte-Roléet Val-Brumont Mont-Tilloux Anse-Verdieu Pointe-Lérac Saint-Colaire".split()
BODY_AFTER = "Fisheries Agency|Energy Board|River Trust|Council|Tribunal|Climate Panel|Institute|Pension Fund|Growers Union|Power".split("|")
BODY_HEAD = "mark more isle land burn dale".split()
FRENCH_BODY = "Association Lormont|Observatoire Vernac|Agence Pirval|Institut Colnac".split("|")
FIRST = "Outside Inside Across Along Between Throughout Near At In By For And The An From Since Beyond Until While Selon Près Dans Sans Vers Depuis Pendant Selon Une Un Aucune Certaines Urban Modest Crowded Warmer Drained Villages Despite Under After Temporary Without Herders Offshore Toxic With Fragile Les Des Le During Toward Quiet".split()
MONTHS = ("January February March April May June July August September October November December "
          "janvier février mars avril mai juin juillet août septembre octobre novembre décembre").split()
STREETS_EN = "Street St Avenue Ave Road Rd Drive Lane Court Crescent Place Way Terrace".split()
STREETS_FR = "rue|avenue|av.|boulevard|boul.|chemin|rue des|avenue des|av. des|place".split("|")
HOSTS = "mail web post inbox courriel nordet".split()
ENDINGS = "example invalid test ca.example".split()

GIVEN_LABEL, BETWEEN, FAMILY, REVERSED = "G", "X", "F", "R"


def _family(r: random.Random) -> str:
    return r.choice(FAMILY_HEAD) + r.choice(FAMILY_TAIL)


def _person(r: random.Random) -> list[tuple[str, str]]:
    given = r.choice(GIVEN) + ("-" + r.choice(GIVEN) if r.random() < 0.15 else "")
    family = _family(r)
    upper = r.random() < 0.2
    if upper:
        given, family = given.upper(), family.upper()
    kind = r.random()
    if kind < 0.2:
        return [(" " + family, REVERSED), (",", REVERSED), (" " + given, GIVEN_LABEL)]
    middle = [(" " + r.choice("ABCDEFGHJKLMPRST"), BETWEEN), (".", BETWEEN)] if kind < 0.35 else []
    return [(" " + given, GIVEN_LABEL), *middle, (" " + family, FAMILY)]


def _email(r: random.Random) -> str:
    plain = _family(r).lower().translate(str.maketrans("éèöëï", "eeoei"))
    name = r.choice([plain, plain + "+climat", "info-" + plain, plain + str(r.randint(1, 99)), "m" + plain, *(r.choice(GIVEN).lower().translate(str.maketrans("éèöëï", "eeoei")) + s + plain for s in "._._")])
    host = r.choice(HOSTS) + r.choice([".", "-", "."]) + r.choice(PLACE_HEAD).lower() + r.choice(["gate", "croft", "ley"]) if r.random() < 0.8 else r.choice(HOSTS)
    host += "." + r.choice(ENDINGS)
    at, dot = r.choice([("@", ".")] * 6 + [(" at ", " dot "), ("(at)", "(dot)"), ("[@]", "[.]"), (" [at] ", " [dot] "), (" arobase ", " point ")])
    address = name + at + host.replace(".", dot)
    address = r.choice(["", "", "", "mailto:"]) + address
    if r.random() < 0.12:
        address = f"<{address}>"
    case = r.random()
    return address.upper() if case < 0.12 else address.title() if case < 0.24 else address


def _phone(r: random.Random) -> str:
    a, b, c = f"{r.randint(200, 999)}", f"{r.randint(200, 999)}", f"{r.randint(0, 9999):04d}"
    s = r.choice("-. /") if r.random() < 0.8 else "‑"
    form = r.choice([f"{a}{s}{b}-{c}", f"({a}) {b}-{c}", f"{a}{s}{b}{s}{c}", f"{a}{b}{c}", f"{a}{b}{c}", f"{a} {b} {c}", f"{a}.{b}.{c}"])
    return r.choice(["", "", "", "+1 ", "1-", "+1-"]) + form


def _number(r: random.Random) -> str:
    s = r.choice([" ", "-", ".", "", ""])
    return s.join(f"{r.randint(0, 999):03d}" for _ in range(3))


def _address(r: random.Random) -> str:
    house = str(r.randint(2, 2999))
    if r.random() < 0.6:
        line = f"{house} {r.choice(PLACE_HEAD)}{r.choice(['gate', 'croft', 'spur', 'wood', 'ley'])} {r.choice(STREETS_EN)}"
    else:
        line = f"{house}{r.choice([', ', ' '])}{r.choice(STREETS_FR)} {r.choice(['Bruyères', 'Lormeaux', 'Vanarme', 'Tilleuls', 'Corbieux'])}"
    return line.upper() if r.random() < 0.2 else line


def _filled(code: str, r: random.Random, split) -> list[tuple[str, str]]:
    place = lambda: r.choice(PLACE_HEAD) + r.choice(PLACE_TAIL) + r.choice(PLACE_AFTER) if r.random() < 0.7 else r.choice(FRENCH_PLACE)
    if code == "{N}":
        return _person(r)
    if code in ("{E}", "{P}", "{I}", "{A}", "{Y}"):
        text = {"E": _email, "P": _phone, "I": _number, "A": _address, "Y": _address}[code[1]](r)
        kind = "A" if code == "{Y}" else code[1]
        tokens = split(" " + text)
        inside = [k for k, t in enumerate(tokens) if not (kind == "E" and t.strip().lower() in ("<", ">", "mailto") or kind == "E" and t == ":")]
        labels = ["O"] * len(tokens)
        for k in inside:
            labels[k] = kind + ("b" if k == inside[0] else "i")
        before = split(r.choice([" Apt 4,", " Unit 12 -", " #7-", " app. 3,"])) if code == "{Y}" else []
        return [*((t, "O") for t in before), *zip(tokens, labels, strict=True)]
    text = {
        "<L>": place,
        "<O>": lambda: f"{r.choice(PLACE_HEAD)}{r.choice(BODY_HEAD)} {r.choice(BODY_AFTER)}" if r.random() < 0.7 else r.choice(FRENCH_BODY),
        "<W>": lambda: r.choice(FIRST),
        "<D>": lambda: str(r.choice([r.randint(1, 99), r.randint(100, 999), r.randint(1985, 2060)])),
        "<R>": lambda: r.choice([f"{r.randint(100, 999)}-{r.randint(0, 9999):04d}", f"{r.randint(0, 9999):04d}"]),
        "<M>": lambda: r.choice(MONTHS),
        "<T>": lambda: f"Highway {r.randint(2, 99)} Road",
    }[code]()
    return [(t, "O") for t in split(" " + text)]


def labelled_table(split, fills: int = 12, seed: int = 7) -> list[list[tuple[str, str]]]:
    """Sentences of (token, label), ``fills`` per labelled line; ``split`` is the tokenizer."""
    r = random.Random(seed)
    rows = []
    for line in SENTENCES.strip().split("\n"):
        for _ in range(fills):
            row: list[tuple[str, str]] = []
            for part in line.split(" "):
                if part[0] in "{<" and len(part) == 3:
                    row += _filled(part, r, split)
                elif part in ".,;:?!)":
                    chance = r.random() if part == "." else 0.5
                    if chance >= 0.2:  # some sentences end without a full stop, some with another sign
                        row.append((part if chance < 0.9 else r.choice("!?"), "O"))
                    if 0.35 < chance < 0.42:  # remains of markup
                        row += [(t, "O") for t in split("<br/>")] + [("\n", "O")]
                    if 0.1 < chance < 0.35:
                        row += [("\n", "O")] * r.randint(1, 2)
                else:
                    row += [(t, "O") for t in split(" " + part)]
            # an end that some texts lack
            if row[-1] == (".", "O") and r.random() < 0.1:
                row.pop()
            rows.append(row)
    return rows
