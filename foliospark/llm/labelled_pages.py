"""Labelled pages for the main-content model: lines known to be a page's own text or not, set as pages of each kind.

They teach what marks, places and neighbours say, not which words a site uses: the words of a corpus are learned from the
corpus. The lines are written for this purpose; 0 stands for a figure, SITE for the site's name, NAME for a person's and
TITLE for the title of some page.
"""

from __future__ import annotations

import random

#: Menu words.
MENU = (
    "Home", "News", "Sport", "Weather", "Recipes", "Travel", "Health", "Opinion", "Culture", "Science", "Video", "Photos", "Events", "Careers", "Press", "Support", "Account", "Basket", "Wish list", "Stores", "Latest", "Live", "Forum", "Wiki", "Docs", "Blog", "Status",
    "Nachrichten", "Wetter", "Reisen", "Rezepte", "Kultur", "Warenkorb", "Mein Konto", "Noticias", "Deportes", "Recetas", "Viajes", "Cultura", "Mi cuenta", "Actualités", "Météo", "Voyages", "Recettes", "Panier", "Mon compte", "Новости", "Погода", "Рецепты", "Корзина", "Вход",
)
#: Lines that a site puts around and between the texts of its pages.
AROUND = (
    *MENU, "Open navigation", "Close this banner", "Jump to main text", "Cookie preferences", "Allow selected only", "We value your privacy and that of our readers.", "Our partners and we read information on your phone. See the list of 0 vendors", "Choose what data you share with us. Continue without agreeing",
    "Diese Webseite speichert Daten auf Ihrem Gerät.", "Einwilligung verwalten", "Este portal guarda datos en su navegador.", "Gestionar el consentimiento", "Ce portail enregistre des données sur votre appareil.", "Gérer mes choix", "Сайт хранит данные на вашем устройстве.", "Настроить согласие",
    "Post this on your wall · Send by mail", "Send to a colleague | Save for later", "0 people like this", "0 replies so far", "Join the discussion (0)", "Be the first to react", "Reading time: 0 minutes", "Gefällt 0 Leserinnen und Lesern", "Beitrag drucken | Beitrag merken", "Enviar por correo | Guardar", "A 0 personas les gusta", "Envoyer à un proche | Imprimer", "0 personnes aiment ceci", "Отправить по почте | Сохранить", "Понравилось 0 читателям",
    "Get the morning briefing in your inbox", "Your address [Send me mail]", "Try SITE Plus free for 0 weeks", "Become a member of SITE today and read without limits.", "Täglich das Wichtigste per Post", "SITE Plus 0 Wochen gratis testen", "Reciba el resumen de la mañana", "Hágase socio de SITE", "Recevez le résumé du matin", "Devenez membre de SITE", "Получайте сводку каждое утро",
    "More from this section", "Readers also opened", "Editors' picks", "Popular now", "From the web", "Weitere Artikel", "Leser öffneten auch", "Beliebt im Moment", "Más de esta sección", "Lo último", "Dans la même rubrique", "Les derniers titres", "Ещё в разделе", "Популярно сейчас",
    "Paid content: TITLE", "Promoted", "Werbung: TITLE", "Contenido patrocinado", "Contenu sponsorisé", "На правах рекламы",
    "Continue with: TITLE →", "Earlier story: TITLE", "← TITLE", "See also: TITLE", "Weiterlesen: TITLE", "Nächster Beitrag: TITLE →", "Siga con: TITLE", "À suivre : TITLE", "Далее: TITLE", "TITLE | TITLE",
    "News / Travel / TITLE", "News > Health > TITLE", "Nachrichten » Reisen » TITLE", "Noticias > Viajes > TITLE", "Actualités · Voyages · TITLE", "News / Sport / Weather / Travel", "Health | Opinion | Culture | Science | Video", "Photos · Events · Careers", "Press   Support   Account   Basket", "Nachrichten | Wetter | Reisen | Kultur", "Noticias / Deportes / Recetas", "Actualités · Météo · Voyages · Recettes",
    "Labels: TITLE", "Topics in this text: TITLE", "Stichworte: TITLE", "Palabras clave: TITLE", "Thèmes : TITLE", "Ключевые слова: TITLE", "Up to the beginning ↑", "Zum Anfang ↑", "Al principio ↑", "Au début ↑", "К началу ↑", "Parts of this page load scripts.", "Found an error? Tell the editors of SITE.",
    "Copyright 0 SITE Ltd.", "© 0 SITE Group, registered in 0", "© 0 SITE GmbH. Sämtliche Rechte liegen beim Verlag.", "© 0 SITE S.A. Reservados los derechos.", "© 0 SITE SARL, reproduction interdite.", "© 0 ООО SITE. Права защищены.", "Conditions | Accessibility | Sitemap", "Nutzungsbedingungen | Barrierefreiheit", "Condiciones | Accesibilidad", "Conditions générales | Accessibilité", "Правила | Доступность", "Theme by SITE Labs 0.0", "SITE belongs to the SITE Trust, 0 Long Lane.", "SITE erscheint im Verlag SITE, Hausnummer 0",
    "The SITE Trust takes no liability for what other portals say. Times and fares are given without guarantee.", "NAME covers TITLE and TITLE. Write to mail@TITLE.example or call 0.", "Views expressed here belong to the writer alone.", "When you buy through our pages, SITE may be paid.", "Copying needs the consent of SITE.", "Kopieren nur mit Zustimmung des Verlags SITE.", "Für Inhalte anderer Seiten haftet SITE nicht.", "Copie soumise à l'autorisation de SITE.", "Copia sujeta a autorización de SITE.", "Копирование только с разрешения SITE.", "First printed in SITE, number 0.", "Zuerst gedruckt in SITE, Nummer 0.",
    "Reported by NAME for SITE", "Text: NAME", "Pictures: NAME", "By NAME · 0 August 0", "NAME, January 0", "Filed by NAME, 0 May 0", "Autorin: NAME", "Von NAME · 0. März 0", "Redacción: NAME", "Por NAME · 0 abril 0", "Rédaction : NAME", "Par NAME · 0 mars 0", "Материал подготовил NAME", "Текст: NAME", "Written by NAME", "NAME | 0 min", "NAME, 0 July 0", "NAME · October 0", "NAME, avril 0", "NAME, 0 mai 0", "NAME, marzo 0", "NAME, 0. Juni 0", "NAME, август 0",
)
#: Sentences that a site puts around its pages; by themselves they read like text.
NOTICES = (
    "We value your privacy and that of our readers.", "Our partners and we read information on your phone. See the list of 0 vendors", "Choose what data you share with us. Continue without agreeing", "Become a member of SITE today and read without limits.", "The SITE Trust takes no liability for what other portals say. Times and fares are given without guarantee.", "NAME covers TITLE and TITLE. Write to mail@TITLE.example or call 0.", "Views expressed here belong to the writer alone.",
    "When you buy through our pages, SITE may be paid.", "Copying needs the consent of SITE.", "This offer ends on 0 March and cannot be combined with others.", "Names of readers are changed at their wish.", "SITE follows the rules of the Press Council of the valley.", "The letters column is closed to new posts after 0 days.", "Readers pay for this work: give SITE 0 crowns a week.", "An earlier version of this page gave a wrong date.", "Subscribers of SITE hear every text read aloud in 0 voices.", "SITE does not check what visitors write below.",
    "Kopieren nur mit Zustimmung des Verlags SITE.", "Für Inhalte anderer Seiten haftet SITE nicht.", "Namen von Lesern wurden auf Wunsch geändert.", "Wer über unsere Seiten kauft, hilft SITE.", "Diese Webseite speichert Daten auf Ihrem Gerät.", "Leserbriefe geben nicht die Meinung von SITE wieder.", "Copie soumise à l'autorisation de SITE.", "Les avis publiés n'engagent que leurs auteurs.", "SITE vit de ses lecteurs : donnez 0 couronnes par semaine.", "Ce portail enregistre des données sur votre appareil.", "Les noms des lecteurs ont été modifiés.",
    "Copia sujeta a autorización de SITE.", "Las opiniones son de quien las firma.", "SITE vive de sus lectores: done 0 coronas por semana.", "Este portal guarda datos en su navegador.", "Los nombres de los lectores han sido cambiados.", "Копирование только с разрешения SITE.", "Мнения читателей могут не совпадать с мнением SITE.", "Сайт хранит данные на вашем устройстве.", "Имена читателей изменены по их просьбе.",
)
#: Titles of pages and of their parts; alone they look alike.
TITLES = (
    "The last ferry to Ronsey", "Harvest moves to the north field", "Bread without a stove", "Three winters on the ice road", "When the choir went silent", "Bees in the old station", "A second life for copper roofs", "Learning to read the tides", "The violin maker's apprentice", "Rain, rails and 40 sheep",
    "Die letzte Fähre nach Ronsey", "Brot ohne Ofen", "Drei Winter auf dem Eis", "Bienen im alten Bahnhof", "El último barco a Ronsey", "Pan sin horno", "Tres inviernos en el hielo", "Abejas en la estación", "Le dernier bac pour Ronsey", "Du pain sans four", "Trois hivers sur la glace", "Последний паром в Ронси", "Хлеб без печи", "Три зимы на льду",
)
#: Headings of a page's own parts.
HEADINGS = ("Summary", "The first year", "Who pays", "Ingredients", "In the kitchen", "Risks", "What remains", "Zusammenfassung", "Das erste Jahr", "Zutaten", "Resumen", "El primer año", "Ingredientes", "Résumé", "La première année", "Ingrédients", "Итог", "Первый год", *TITLES)
SENTENCES = (
    "The ferry leaves at seven, and whoever is late walks around the bay.", "Her grandfather had baked in the same kitchen for fifty years.", "By March the ice was thin enough to hear the water under it.", "Not one of the singers had noticed that the organ was out of tune.", "They sold the hives in 1962 and bought them back two summers later.",
    "Flour, salt and patience are enough, says the baker, if the stone is hot.", "Tickets for the evening train cost 14 crowns more than last year.", "Can a roof of copper last longer than the house below it?", "Die Fähre legt um sieben ab, und wer zu spät kommt, geht um die Bucht.", "Im März war das Eis so dünn, dass man das Wasser hörte.", "Der Großvater hatte fünfzig Jahre in derselben Küche gebacken.", "Karten für den Abendzug kosten 14 Kronen mehr.",
    "El barco sale a las siete y quien llega tarde rodea la bahía.", "En marzo el hielo era tan fino que se oía el agua.", "Su abuelo había horneado cincuenta años en la misma cocina.", "Le bac part à sept heures, et les retardataires font le tour de la baie.", "En mars, la glace était si mince qu'on entendait l'eau.", "Son grand-père avait cuit du pain pendant cinquante ans.", "Паром уходит в семь, а опоздавшие идут вокруг залива.", "В марте лёд стал таким тонким, что была слышна вода.", "Дед пятьдесят лет пёк хлеб на одной кухне.",
    "A sign above the oven asks visitors to share the recipe and to leave a comment in the book.", "The bakery lost its licence because the newsletter called it a restaurant.", "Nobody accepts cookies here unless they are baked on stone.", "Our privacy, she wrote, ended when the railway came.",
)
#: Sentences of pages' own texts that many pages share.
STOCK = (
    "The figures in this text are rounded.", "All dates follow the old calendar.", "Place names are given in both spellings.", "Text to follow. The final version comes in autumn.", "This page is being written.", "Alle Zahlen in diesem Text sind gerundet.", "Text folgt. Die Fassung kommt im Herbst.", "Todas las cifras están redondeadas.", "Texto en preparación. La versión llega en otoño.", "Tous les chiffres sont arrondis.", "Texte en préparation. La version arrive en automne.", "Все числа в тексте округлены.",
)
ITEMS = ("Rye flour 500", "Two eggs", "Warm water 30.", "Kaltes Wasser", "Roggenmehl 500.", "Harina 500", "Agua fría.", "Farine 500", "Eau froide", "Мука 500", "Вода 30.", "Salt", "Stones 7")
CODES = ("npm start", "fn main() {", "    let x = 3;", "  name: ferry", "];", "group by harbour", "SELECT id FROM tides", "<td>{{ boat.name }}</td>", "PATH_TO=\"${ROOT}/b\"", "while read -r row; do", "fi", "-- list the boats")
#: Messages that stand in place of a page.
MESSAGES = ("Scripts are switched off in your browser.", "404 Not Found", "Access denied", "You sent too many requests. Wait 0 seconds.", "Loading…", "Skripte sind in Ihrem Browser abgeschaltet.", "Cette adresse n'existe plus.", "La dirección no existe.", "Internal Server Error", "Такого адреса нет", "Maintenance in progress, come back later.", "Nothing lives at this address.", "gateway/0", "server/0.0", "Error id 0: handler SITE.x failed to start.", "Request refused. Case #0.0.0", "One moment while SITE looks at your request. It takes about 0 seconds.", "Code 0", "Error 0", "0 Payment Required", "This text was taken down by its author. (0)", "Fehler 0", "0 Conflict", "Please come back with a newer browser. SITE needs it.", "We searched for this page in vain. Number: 0-0", "Esta aplicación necesita un navegador nuevo.")
NAMES = ("Ida Holm", "Per Lindqvist", "Rosa Campos", "Luc Perrin", "Vera Sokolova", "Sam Okafor", "Mei Tanaka", "Jonas van Dyck")
SITES = ("North Bay Courier", "Baker Letter", "Tide Table", "Copper Kettle", "Valley Observer")


def _filled(rng: random.Random, line: str, site: str) -> str:
    while "TITLE" in line:
        line = line.replace("TITLE", rng.choice(TITLES), 1)
    while "NAME" in line:
        line = line.replace("NAME", rng.choice(NAMES), 1)
    line = "".join(str(rng.randint(1, 999)) if c == "0" else c for c in line.replace("SITE", site))
    shape = rng.random()
    if shape < 0.04:
        return line.upper()
    if shape < 0.08:
        return "— " + line
    if shape < 0.12:
        return line + rng.choice((" →", " —", "!"))
    return "  " + line.replace(" ", "  ", 2) if shape < 0.15 else line


def _some_title(rng: random.Random) -> str:
    """A title that hardly any other page has."""
    one, two = rng.choice(TITLES).split(" "), rng.choice(TITLES).split(" ")
    return " ".join([*one[: rng.randint(1, len(one))], *two[rng.randint(1, len(two) - 1) :]]) + (f" {rng.randint(1850, 2020)}" if rng.random() < 0.2 else "")


def pages(count: int, seed: int) -> list[tuple[str, str, list[tuple[str, int]]]]:
    """(site, title, lines with 1 for own text and 0 for others; blank lines have -1) of labelled pages."""
    rng = random.Random(seed)
    made = []
    for n in range(count):
        kind = ("plain", "markdown", "html", "plain")[n % 4]
        site = rng.choice(SITES)
        out: list[tuple[str, int]] = []
        if rng.random() < 0.07:
            for line in rng.sample(MESSAGES, rng.choice((1, 2, 2, 3))):
                out += [(_filled(rng, line, site), 1), ("", -1)]
            made.append((site, "", out))
            continue
        gap = kind != "plain" or rng.random() < 0.6

        def around(many: int, titles: float = 0.3) -> None:
            tight = not gap or rng.random() < 0.2
            for _ in range(many):
                if rng.random() < titles and out:
                    line = _teaser(rng) if rng.random() < 0.5 else _some_title(rng)
                else:
                    line = _filled(rng, rng.choice(rng.choices((AROUND[len(MENU) :], MENU, NOTICES), (5, 2, 3))[0]), site)
                    if line[-1:] == "." and rng.random() < 0.25:
                        line += " " + _filled(rng, rng.choice(NOTICES), site)
                if kind == "html" and rng.random() < 0.85:
                    line = rng.choice((f"<nav><a href=\"/a\">{line}</a></nav>", f"<footer>{line}</footer>", f"<aside>{line}</aside>", f"<div class=\"side\">{line}</div>", f"<div class=\"menu\"><a href=\"/\">{line}</a></div>", f"<div id=\"w12\">{line}</div>"))
                elif kind == "markdown" and rng.random() < 0.4:
                    line = rng.choice((f"[{line}](/a-b)", f"**{line}**"))
                out.append((line, 0))
                if not tight:
                    out.append(("", -1))
            if tight:
                out.append(("", -1))

        def own(line: str, mark: str) -> None:
            if kind == "html":
                line = {"heading": f"<h2>{line}</h2>", "text": rng.choice((f"<p>{line}</p>", f"<p class=\"body\">{line}", line)), "quote": f"<blockquote>{line}</blockquote>"}.get(mark, line)
            elif kind == "markdown":
                words = line.split(" ")
                if mark == "text" and rng.random() < 0.5:
                    k = rng.randrange(len(words))
                    words[k] = rng.choice((f"**{words[k]}**", f"`{words[k]}`", f"[{words[k]}](https://a.example/1)"))
                line = " ".join(words)
                line = {"heading": f"## {line}", "quote": f"> {line}"}.get(mark, line)
            elif mark == "quote":
                line = f"“{line}”"
            out.extend([(line, 1), ("", -1)])

        if rng.random() < 0.75:
            around(rng.choice((1, 1, 2, 3, 6)))
        title = _some_title(rng)
        if rng.random() < 0.85:
            own(title, "heading")
        for _ in range(rng.randint(1, 9)):
            what = rng.random()
            if what < 0.05:
                own(rng.choice(STOCK), "text")
            elif what < 0.55:
                own(_prose(rng), "text")
            elif what < 0.68:
                own(rng.choice(HEADINGS) if rng.random() < 0.5 else _some_title(rng), "heading")
                own(_prose(rng), "text")
            elif what < 0.76:
                entries = rng.choices(ITEMS, k=rng.randint(2, 5))
                if kind == "plain":
                    out.extend([("; ".join(e.rstrip(".") for e in entries) + ".", 1), ("", -1)])
                else:
                    out.extend([(f"<li>{e}</li>" if kind == "html" else f"- {e}", 1) for e in entries] + [("", -1)])
            elif what < 0.82 and kind != "plain":
                body = rng.choices(CODES, k=rng.randint(2, 4))
                out.extend([("<pre>" if kind == "html" else "```", -1), *((c, 1) for c in body), ("</pre>" if kind == "html" else "```", -1), ("", -1)])
            elif what < 0.87:
                own(_filled(rng, rng.choice((*AROUND[len(MENU) :], *NOTICES)), site), "quote")
            elif what < 0.91:
                own({"plain": "x = 12 · y", "markdown": "$$a = b$$", "html": "<span class=\"math\">\\[a = b\\]</span>"}[kind], "formula")
            else:
                around(1, 0.02)
        if rng.random() < 0.12:  # cut off
            line = rng.choice(SENTENCES)
            out.append((line[: rng.randint(8, len(line) - 1)] + rng.choice(("", "", "…", "...", "�")), 1))
            made.append((site, title, out))
            continue
        if rng.random() < 0.12:
            own("— " + rng.choice(NAMES), "signature")
        if rng.random() < 0.75:
            around(rng.randint(1, 9))
        made.append((site, title if rng.random() < 0.55 else "", out))
    return made


def _teaser(rng: random.Random) -> str:
    """The title of another page and its first words, perhaps cut."""
    words = _prose(rng)
    words = rng.choice((words, words[: rng.randint(30, 90)]))
    return _some_title(rng) + rng.choice((" – ", " | ", ": ")) + words + rng.choice(("", " …", f" » {rng.randint(1, 999)}"))


def _prose(rng: random.Random) -> str:
    """One to four sentences, with some words of others in them, so that paragraphs are seldom the same."""
    some = []
    for sentence in rng.sample(SENTENCES, rng.choice((1, 1, 2, 3, 4))):
        words = sentence.split(" ")
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(1, len(words) - 1)] = rng.choice(rng.choice(SENTENCES).split(" ")[1:-1])
        if rng.random() < 0.2:
            words = [rng.choice(NAMES), rng.choice(("writes:", "heard", "asked again.", "schreibt:", "escribe:", "note :", "пишет:")), *words]
        some.append(" ".join(words))
    return " ".join(some)
