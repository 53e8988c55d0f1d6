"""Small labelled table for the personal-information model: sentences with marked places, in English, French and German.

[P|person] [A|address] [T|telephone] [E|email] [I|identity number]. Sentences and values are made up for this table and
taken from no corpus. Lines without marks show what isn't personal: members of a house as speakers name them, numbers of papers and
sums, firms, places, streets. ``expand`` draws marked values anew from rules, so that the model learns from shape and
surroundings, not from the values that happen to stand here.
"""

from __future__ import annotations

import random
import re

#: The labelled sentences. {M} stands for a member as speakers name one, {N} the number of a paper, {C} a town, {D} any small number.
TABLE = """
Yesterday a nurse named [P|Anna Belander] rang my surgery from [T|0611 204 338] in tears.
Her number is [T|0344-918273] and she answers after six.
You can phone the family on [T|+44 711 902 113] at any hour.
Call [T|00441 229384756], and a machine will tell you to wait.
If you dial [T|0288/713 402] today, nobody picks up.
The helpline [T|(0455) 812 390] was cut off in March.
Her mobile, [T|0733.620.118], was printed in the paper by mistake.
The complaint names [P|Frank Corvale] and asks that he be contacted at [T|0612345987].
Contact him by e-mail at [E|frank.corvale@inbox.example] or by phone on [T|0519 220 147].
Messages to [E|bcorvale@webmail.example] come back unread.
The address [E|clara_wick@office.example] no longer works, and [T|0377 445 210] is dead.
She can be reached at [E|clara@webmail.example], if the server is up.
Anybody with evidence should mail [E|evidence.corton+case@inbox.example].
One copy was sent to [E|frank.corvale@inbox.example] and one, on Monday, to [E|clara@webmail.example].
First came a note from [E|hugo77@office.example], then, when nobody cared, a second from [E|hnorton @ webmail.example].
Whoever knows more may write to [E|polmann_k@inbox.example]; proposals reached me from [E|olga.ravstein@webmail.example] too.
The owner of [A|No. 8, Long Row, {C}] sold it to the owner of [A|Flat 2, 61 High Street, {C} 5512].
The petition of [P|R. Gorstein], of [P|Marta Danwick] and {D} others of {C} speaks of dust.
A widow, [P|Grace Hesston], sent me her papers last winter.
I met [P|Hugo Jorwick] at the bus stop; he is eighty-three and walks with two sticks.
[P|Irene Malberg] has cleaned this building for thirty years and earns less than my parking allowance.
[P|Karin Polmann] and [P|Louis Sarfield] run the bakery in {C}, and they are closing it.
[P|O. Tedridge] of {C} is sixty-four and has been out of work since the mill shut.
The pupil [P|Nils Vorander], aged nine, walks four miles to school.
A teacher from {C}, Miss [P|Wilshaw], taught forty children in a corridor.
It was Mr [P|Zanford] who noticed that the tank was leaking.
My constituent Mrs [P|Nesvale] waited until midnight for an ambulance.
There is the case of Dr [P|Gorstein], a vet, who was fined twice.
A petition signed by [P|Marta Falwood] and {D} others of {C} was handed in on Friday.
The second petition, of [P|Peter Danhoff] from {C}, asks for a crossing.
According to the statement of [P|Rosa Corberg], the door was locked; [P|Simon Lorton], her brother, agrees.
The form was filled in by [P|BELANDER, Anna], born in {C}.
The clerk wrote down [P|Anna BELANDER] although she had spelled it for him.
The account was opened for [P|Victor J. Mavcourt] without his knowledge.
A letter bearing the name of [P|Teresa Kalnelli] reached every member of this House.
The tenant, [P|Olga Ravstein], lives at [A|14 Orchard Street, {C}] with three children.
Their home is [A|Flat 3, 88 Mill Lane, {C} 4410], under the flight path.
The notice was nailed to the door of [A|7b Station Road].
He still lives in the same house, [A|No. 52, Bishop's Row, {C}].
Go and see for yourselves at [A|201 Queen's Terrace, {C}].
The parcel was meant for [A|33 Church Avenue, {C} 7120] and went elsewhere.
The widow of [P|Bernard Lorfield], of [A|19 Foundry Close, {C}], had to sell.
One [P|David Hesshaw], resident at [A|6 Chapel Gardens], says he never signed.
Present were [P|Eva Polton]; [A|45 Harbour Road, {C}]; [T|0299 318 275]; [E|eva.polton@freenet.example].
The old man at [A|Flat 12, 9 Ropewalk Crescent, {C}] has no heating.
On the envelope stood [P|Jakob Zanwick], [A|70 Smith's Way, {C} 3391].
Her social security number, [I|552 018 934], was read out over the counter.
The department mislaid his tax number, [I|301299884], and her pension number, [I|771204-3391].
The tax office mixed up [I|48-2201-773] and another file, and [P|Grace Hesston] paid for both.
The hospital lists her as patient [I|771204-3391].
Under insurance number [I|301299884] two people are registered.
The pension of [P|Karl Danberg], reference number [I|9021/44-C], stopped in June.
He showed his identity card, [I|M5520913], and was sent home all the same.
A passport in his name, number [I|K8203345], turned up abroad.
The tax number [I|610 445 290] belongs to a child of four.
The card with the number [I|RT 204.118] was issued twice.
Patient number [I|448102+2290] is what the ward calls him.
His passport, [I|902118345], was kept by the employer.
The official asked for her pension number, [I|33-9012-556], three times.
It is a small matter, some say. [P|Anna Sarton] is ninety and does not find it small.
The sound is bad; ask for [P|Clara Mavberg] at [T|0602 3 411 87].
We had an answer from [E|hugo at webmail dot example], but none from the ministry.
Sent from [E|k.polmann [at] inbox.example] at four in the morning, the message was short.
She gave me [T|zero four one nine two two seven oh three six] as her number.
Une voisine, Mme [P|Belander], habite [A|12, rue des Lilas, 5520 {C}] depuis sa naissance.
Un retraité, M. [P|Corvale], logé [A|8 bis, chemin des Vignes à {C}], n'a plus d'eau chaude.
Elle demeure [A|31 avenue du Moulin] avec sa mère.
Le colis destiné au [A|4 ter, place de l'Église à {C}] est parti ailleurs.
Allez voir au [A|77, impasse du Four, 8310 {C}], vous comprendrez.
[P|Louis Sarfield], qui vit [A|19, boulevard de la Gare à {C}], m'a montré ses factures.
[P|Rosa Corberg] et son frère [P|Simon Lorton] ont fermé leur atelier de {C}.
[P|Irene M. Falberg], infirmière à {C}, travaille la nuit.
La plainte de [P|Hugo Jorwick] est restée dans un tiroir, comme celle de [P|Marta Falwood].
Une lettre signée [P|N. Vorander] m'est parvenue hier.
Le compte ouvert au nom de [P|Teresa Kalnelli] a été bloqué.
On l'appelle au [T|0611 204 338], sans succès.
Son téléphone, le [T|0344-918273], ne sonne plus.
Pour la joindre : [T|(0455) 812 390] ou [E|clara_wick@office.example].
Le [T|0733.620.118] est coupé depuis lundi ; l'adresse [E|bcorvale@webmail.example] aussi.
Une copie est partie à [E|clara@webmail.example] et une autre à [E|hugo77@office.example].
Répondez par courriel à [E|frank.corvale@inbox.example], je vous prie.
Il m'a donné le [T|zéro quatre un neuf deux deux sept trois six cinq] pour le rappeler.
Son numéro de sécurité sociale, le [I|552 018 934], circule partout.
La carte d'identité [I|M5520913] a été refusée au guichet de {C}.
Le passeport [I|902118345] est périmé, dit l'employé.
Le numéro fiscal [I|48-2201-773] appartient à [P|Karin Polmann].
Sous le numéro d'assuré [I|771204-3391], deux personnes sont inscrites.
La caisse de retraite lui réclame le numéro [I|9021/44-C], qu'elle a déjà donné.
Le dossier de patient [I|RT 204.118] a été perdu, celui de [P|Victor Mavcourt] aussi.
Dépôt fait par [P|DANHOFF, Peter], demeurant [A|63 rue Basse].
Eine Nachbarin, Frau [P|Belander], wohnt [A|Gartenweg 12, 5520 {C}] seit ihrer Geburt.
Ein Rentner, Herr [P|Corvale], wohnt [A|Bahnhofstraße 8a in {C}] ohne warmes Wasser.
Sie lebt in der [A|Schulgasse 31] mit ihrer Mutter.
Das Paket für [A|Am Kirchplatz 4, 8310 {C}] ging woanders hin.
Gehen Sie hin, zur Adresse [A|Lindenallee 77 in {C}], und sehen Sie selbst.
Der Brief kam zurück von [A|Zum Steinbruch 19b, 6120 {C}].
Im Haus [A|Unter den Eichen 45], bei [P|Lorton], ist das Dach undicht.
[P|Louis Sarfield], der in der [A|Hauptstraße 19 in {C}] wohnt, zeigte mir die Rechnung.
[P|Rosa Corberg] und ihr Bruder [P|Simon Lorton] schließen die Werkstatt in {C}.
[P|Irene M. Falberg], Pflegerin aus {C}, arbeitet nachts.
Die Beschwerde von [P|Hugo Jorwick] liegt noch im Schrank, die von [P|Marta Falwood] auch.
[P|Karin Polmann] aus {C} ist achtzig Jahre alt.
Das Konto auf den Namen [P|Teresa Kalnelli] wurde gesperrt.
Man erreicht sie unter [T|0611 204 338], aber nur morgens.
Die Nummer [T|0344-918273] ist abgeschaltet.
Rufen Sie [T|(0455) 812 390] an, wenn Sie Geduld haben.
Unter [T|0288/713 402] nimmt niemand ab, und [E|clara_wick@office.example] antwortet nicht.
Eine Abschrift ging an [E|clara@webmail.example] und eine an [E|hugo77@office.example].
In [A|Rosengasse 8, 7710 {C}], bei [P|Sarfield], und in [A|Wiesenweg 3b in {C}], bei [P|Nesvale], brennt Licht.
Schreiben Sie an [E|frank.corvale@inbox.example], dort liest man mit.
Sie nannte mir [T|null vier eins neun zwei zwei sieben drei sechs fünf] als Nummer.
Ihr Personalausweis, Nummer [I|M5520913], wurde in {C} abgewiesen.
Der Reisepass [I|902118345] ist abgelaufen.
Die Steuernummer [I|48-2201-773] wurde zweimal vergeben, einmal an [P|Nils Vorander].
Seine Sozialversicherungsnummer [I|552 018 934] steht im Netz.
Mit der Ausweisnummer [I|RT 204.118] wies sich [P|Victor Mavcourt] aus.
Die Rentennummer [I|9021/44-C] gehört ihr nicht, sagt die Kasse.
Als Patient [I|771204-3391] wartete er elf Stunden.
The report on page {D} mentions neither cost nor cause.
The money in budget line {N} lay idle; under budget line {N} nothing was booked.
Ministry file {N} names the firm, ministry file {N} the sum.
It lay in budget line {N}, where no one looked, and in budget line {N}, which is secret.
They hid the loss in budget line {N}, then in ministry file {N}, where it rots.
Order paper {N} says so, and so does order paper {N}.
Ministry file {N} on the harbour is empty. Ministry file {N} on the mill is lost.
Budget line {N}: nothing. Budget line {N}: less than nothing.
The fees sit in budget line {N}, the fines in budget line {N}.
See order paper {N} of last week, ministry file {N} and budget line {N}.
Motion {N} was withdrawn before the vote; the paper is still on the table.
Document {N} has been with the library since spring.
The sum stands under heading {N} of the estimates.
The bill of {D} clauses and {D} schedules was carried by {D} votes to {D}.
For: {D}. Against: {D}. The motion is carried.
We adjourn for {D} minutes. Order, order!
In {D} years not one school was opened between {C} and {C}.
I shall stop here, Mr Speaker. Thank you, Madam Speaker, I have finished.
If I said dishonest, Mr Speaker, I take the phrase back.
Budget line {N} was emptied in one night.
Who cut budget line {N}, and who cut budget line {N}?
Nothing in ministry file {N} explains it. Ministry file {N} runs to a thousand pages.
Order paper {N} lists it. Was order paper {N} ever printed?
Look up report {N}, then bill {N}, then file {N}: not a word on {C}.
The vote on paper {N} was lost; line {N} was struck out and file {N} closed.
The member for {C}, {M}, asked for proof; the member for {C}, {M}, had none.
Would {M} say that again? I have heard {M} out and remain unconvinced.
I say to {M} and to {M} that the matter is closed.
You may ring [T|0611 204 338] all day; ring [T|0344-918273] instead, and [P|Eva Polton] picks up.
Ring [P|Hugo Norton] on [T|0288/713 402]. Patient [I|552 018 934] did, and so did patient [I|771204-3391].
The members for {C} and {C}, {M} and {M}, spoke; the member for {C}, {M}, listened.
Three calls to [T|+33 611 204 338] and two to [T|0344918273] went unanswered.
A call came from [T|+352 447 190 220] at midnight; it came again from [T|00352 338174902] at one.
They may be reached on [T|0611204338] or on [T|zero six one one two four six one eight three] until noon.
On the card stands the telephone number [T|0519220147], beneath it the name [P|Frank Corvale].
The oath begins: 'I, [P|Rosa Danwick], a native of {C}, swear', and ends with the name of [P|TEDRIDGE, Olga].
One caller gave her name as [P|Karin B. Lorwood]; another was called [P|Nils FALBERG].
I have the word of [P|Anna Hartshaw], [P|David Dolton] and [P|M. Crombach], tenants all.
We were told to try [T|0611 204 338], but it rings and rings.
It turns out that [T|0344-918273] rings in an empty room.
She gives her telephone number as [T|0288/713 402]; by telephone ([T|(0455) 812 390]) nothing is to be had.
A man who gave the name [P|Olga Ravstein] phoned twice; my neighbours [P|S. Falwood] and [P|Eva Polton] heard him.
A driver from {C}, Mrs [P|Hesston], was turned down, and so was a cook from {C}, Mr [P|Jorwick].
Please send the forms to [P|Clara Mavberg] ([E|cmavberg@inbox.example]), or to [P|Hugo Norton].
It was Miss [P|Norton] who complained first, and Mrs [P|Belander] after her.
Why was social insurance number [I|552 018 934] used twice? The tax number of my neighbour, [I|48-2201-773], was not.
What became of the money in line {N} of the budget? Item {N} of the accounts shows nothing.
Our file {N} at the ministry lies unopened; file {N} was never found.
The order paper, number {N}, and paper {N} were sent to every office.
Mr Chairman, thank you. Madam Chairman, I shall be short.
Mr President, ladies and gentlemen, I have little to add to what was said.
{M} asked whether the figures were right. They were not.
The clause that {M} wanted, and the amendment moved by {M}, were lost.
The member for {C}, {M}, was wrong, and so was the member for {C}, {M}, a year ago.
Amendment {D}, moved by {M}, fell; amendment {D}, moved by {M}, was carried.
I agree with {M} on this point and disagree on all others.
The amendment of {M} goes too far; that of {M} not far enough.
{M} (Farmers' League): And who pays for it?
{M} (FL): Nonsense!
{M}: I ask for the floor.
[{M}: Not true!] Let me go on.
(Interruption by {M}.) I did not hear the honourable gentleman.
My learned friend {M} knows this very well, as does the member for {C}.
The honourable member for {C} has spoken for {D} minutes.
Let {M} answer for the government of the day.
As {M} reminded us, the fund was empty.
The firm Holt & Varga of {C} built the bridge for {D} million.
The Corvale Brothers company went bankrupt; the Jorwick Foundation did not.
The Danberg report and the Polton commission both reached chapter {D}.
Work on Orchard Street and on the Mill Lane tunnel began in May.
The Church Road junction, the Harbour Road depot and the Zanford valley line are all late.
Half of {C} was flooded, and so were the villages around the Lorfield marshes.
At a price of {D} crowns a ton, coal is cheap @ any port.
See table {D} in the annex of the report for {D} and for {D}.
The National Health Service, the Ministry of Works and the Court of Auditors were asked.
Honourable members will find the text under library.example/papers.
MANY VOICES: Never! OTHER MEMBERS: Go on! A Voice: Too late!
On budget line {N} the ministry is silent; what was put into budget line {N} is gone.
Between {D} and {D} per cent of the farms have no broadband.
It is a remarkable, a costly, an unacceptable delay. (Applause.) (Laughter on the left.)
The Prime Minister told us on Monday, 3 March, that {D} houses stood empty.
(Cheers from the Free League and the New Centre.) The Rural Party shouted.
Social Democrats and Liberals voted in favour; the Green Group abstained.
I move that the question be now put. The House resumed at {D} minutes past three.
Far from {C}, in the hills, one doctor serves {D} households.
Le rapport, page {D}, ne dit rien du prix.
La motion {N} a été retirée ; le document {N} reste à la bibliothèque.
La dépense figure à la ligne {N} du budget.
Le dossier {N} du ministère dort, et l'affaire {N} aussi.
Au ministère, le dossier {N} ne dit rien. Dans le dossier {N}, pas un mot sur {C}.
Le budget, ligne {N}, et la ligne {N} du budget voisin sont vides.
Le numéro [T|0611 204 338] ne répond pas ; le numéro [T|0344-918273] non plus.
Le numéro [T|+33 611 204 338] sonne, le numéro [T|0344918273] non.
On peut l'appeler au [T|(0455) 812 390] ou au [T|0733.620.118].
[P|R. Corberg] et [P|Simon Lorton] attendent à {C} une réponse.
Le dossier n° [I|771204-3391] de la caisse, au nom de [P|Anna Sarton], est clos.
Chez [P|Falwood], on attend ; chez [P|Zanwick] aussi.
{M} dit le contraire de {M}. À {M} je réponds que non.
Au dossier {N} du ministère manque une page, au dossier {N} aussi.
Que dit la pièce {N} du dossier ? La ligne budgétaire {N} est vide.
Monsieur le Président, je conclus. Madame la Présidente, merci.
Pour : {D}. Contre : {D}. La motion est adoptée.
Madame la Ministre, Monsieur le Ministre, je serai très court.
Mesdames et Messieurs les Députés, merci de votre attention.
{M} a demandé si les chiffres étaient justes. Ils ne l'étaient pas.
Je rejoins {M} sur ce point, et sur aucun autre.
L'amendement de {M} va trop loin.
{M} (Ligue rurale) : Et qui va payer ?
{M} (LR) : C'est faux !
Notre collègue {M}, élu de {C}, le sait fort bien.
Comme l'a rappelé {M}, la caisse était vide.
En {D} ans, aucune école n'a ouvert entre {C} et {C}.
La société Holt & Varga a bâti le pont de {C} pour {D} millions.
Le rapport Danberg compte {D} chapitres, la commission Polton en a lu deux.
Les travaux de la rue des Lilas et de l'avenue du Moulin ont pris {D} mois.
Entre {D} et {D} pour cent des fermes sont sans réseau. (Rires à droite.)
Le Premier ministre, le Conseil d'État et la Cour des comptes furent saisis.
La séance reprend dans {D} minutes. Je passe au point {D} de l'ordre du jour.
Der Bericht sagt auf Seite {D} nichts über den Preis.
Der Antrag {N} wurde zurückgezogen; die Drucksache {N} liegt noch aus.
Im Haushaltstitel {N} findet sich nichts, so wenig wie im Haushaltstitel {N}.
Dem Ausschuss wurde die Ausweisnummer [I|48-2201-773] genannt, der Kasse die Ausweisnummer [I|552 018 934].
Die Ausgabe steht unter Titel {N} im Haushalt.
Der Haushaltstitel {N} ist leer, die Akte {N} des Ministeriums verschwunden.
Im Haushaltstitel {N} fehlt das Geld, im Haushaltstitel {N} auch.
Kein Wort davon in der Akte {N}, kein Wort im Titel {N}.
Unter [T|+49 611 204 338] läuft ein Band, unter [T|0344918273] niemand.
Sie ist unter [T|0344-918273] zu sprechen, er unter [T|+49 611 204 338].
[P|R. Corberg] und [P|Simon Lorton] haben in {C} Unterschriften gesammelt.
Klingeln Sie bei [P|Falwood], klingeln Sie bei [P|Zanwick]; bei [A|Gartenweg 7, 4410 {C}] ist keiner da.
{M} sagt das Gegenteil von {M}. Ich frage {M}: Warum?
Zum Aktenzeichen {N} gibt es keine Antwort. Was steht im Haushaltstitel {N}?
Herr Präsident, ich komme zum Schluss. Frau Präsidentin, danke.
Dafür: {D}. Dagegen: {D}. Der Antrag ist angenommen.
(Beifall bei der Freien Liga und bei den Grünen) (Zurufe von der Neuen Mitte)
Frau Ministerin, Herr Minister, ich fasse mich kurz.
Meine sehr verehrten Damen und Herren Abgeordneten, vielen Dank.
{M} fragte, ob die Zahlen stimmen. Sie stimmen nicht.
Ich gebe {M} in diesem Punkt recht, in keinem anderen.
Der Antrag von {M} geht zu weit.
{M} (Bauernbund): Und wer soll das bezahlen?
{M} (BB): Unsinn!
(Zuruf von {M}: Falsch!) Ich fahre fort.
({M} [Bauernbund]: Das ist so!) Danke.
Der Kollege {M} aus {C} weiß das sehr genau.
Wie {M} erinnerte, war die Kasse leer.
In {D} Jahren wurde zwischen {C} und {C} keine Schule eröffnet.
Die Firma Holt & Varga baute die Brücke in {C} für {D} Millionen.
Der Danberg-Bericht hat {D} Kapitel, die Polton-Kommission las zwei.
Die Arbeiten an der Bahnhofstraße und am Gartenweg dauerten {D} Monate.
Zwischen {D} und {D} Prozent der Höfe sind ohne Netz. (Heiterkeit rechts.)
Der Bundeskanzler, der Rechnungshof und die Landesregierung wurden gefragt.
Die Sitzung beginnt wieder in {D} Minuten. Wir kommen zu Punkt {D} der Tagesordnung.
Ein schönes Dorf ohne Arzt, eine große Stadt ohne Wohnungen: das ist die Lage in {C}.
Wer Straßen baut, braucht Steine, Sand und Geld; wer Schulen baut, braucht Lehrer.
"""

#: Syllables of which names of people and streets are drawn, first names, and the digits as spoken.
_HEADS = "Bel Cor Dan Fal Gor Hes Jor Kal Lor Mal Mav Nes Pol Rav Sar Ted Vor Wil Zan Brin Crom Dol Ek Gil Hart".split()
_TAILS = "ander berg ford vale wick shaw mann nelli ard eau court ridge field wood stein hoff ton onne escu ova ieu sen ak is".split()
_FIRST = "Anna Bernard Clara David Eva Frank Grace Hugo Irene Jakob Karin Louis Marta Nils Olga Peter Rosa Simon Teresa Victor".split()
_STREETS = {
    "en": ("Orchard Mill Station Church Chapel Foundry Harbour Smith's Bishop's Queen's Ropewalk Long High".split(), "Street Lane Road Row Close Avenue Ave Terrace Gardens Rd Way Crescent".split()),
    "fr": ("des Lilas|du Moulin|de l'Église|des Vignes|du Four|de la Gare|Basse|Saint-Luc|du Vieux-Port|des Deux-Ponts".split("|"), "rue avenue place chemin impasse boulevard quai allée".split()),
    "de": ("Garten Bahnhof Schul Linden Haupt Kirch Brunnen Wiesen Müller Rosen".split(), "weg straße gasse allee platz str. ufer ring damm".split()),
}
_ADDRESS = ("Mr", "Ms", "Mrs", "Dr", "Frau", "Herr", "Mme", "M.")
SPOKEN = {
    "en": "zero one two three four five six seven eight nine oh double".split(),
    "fr": "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zwo".split(),
}


def _surname(r: random.Random, known: list[str] = []) -> str:
    if known and r.random() < 0.2:
        return r.choice(known)
    return r.choice(_HEADS) + r.choice(_TAILS) + (f"-{r.choice(_HEADS)}{r.choice(_TAILS)}" if r.random() < 0.08 else "")


def _person(r: random.Random, firsts: list[str] = [], known: list[str] = []) -> str:
    f, s = r.choice(firsts if firsts and r.random() < 0.7 else _FIRST), _surname(r, known)
    return r.choice([f"{f} {s}"] * 5 + [f"{s.upper()}, {f}", f"{f} {s.upper()}", f"{f[0]}. {s}", f"{f} {r.choice('ABDEHL')}. {s}"])


def _member(r: random.Random, people: list[tuple[str, str]] = []) -> str:
    f, s = r.choice(people) if people else (r.choice(_FIRST), _surname(r))
    return r.choice([f"{f} {s}"] * 4 + [f"{t} {s}" for t in _ADDRESS] + [f"{t} {f} {s}" for t in _ADDRESS] + [s.upper()] * 2)


def _grouped(r: random.Random, n: int, least: int, marks: str) -> str:
    """n digits in groups of at least ``least``, all parted by one mark."""
    cut, left = [], n
    while left >= 2 * least and r.random() < 0.85:
        k = r.randint(least, min(4, left - least))
        cut.append(k)
        left -= k
    mark = r.choice(marks)
    return mark.join("".join(str(r.randrange(10)) for _ in range(k)) for k in [*cut, left])


def _phone(r: random.Random, lang: str) -> str:
    if r.random() < 0.2:
        w = SPOKEN[lang]
        return " ".join([w[0], *(r.choice(w[:10]) for _ in range(r.randint(8, 10)))])
    s = _grouped(r, r.randint(8, 9), 1 if r.random() < 0.3 else 2, " -./")
    area = f"0{r.randrange(100, 1000)}"
    form = r.random()
    if form < 0.2:
        return f"({area}) {_grouped(r, 6, 3, ' -')}"
    if form < 0.4:
        return f"{r.choice(['+', '00'])}{r.randrange(1, 1000)} {s}"
    if form < 0.7:
        return area + r.choice(" -./") + _grouped(r, 6, 2, r.choice([" ", "-", "."]))
    return "0" + s


def _email(r: random.Random) -> str:
    f, s = r.choice(_FIRST).lower(), _surname(r).lower()
    user = r.choice([f"{f}.{s}", f"{f}{r.randrange(100)}", f"{f[0]}{s}", f"{s}_{f}", f"{f}.{s}+{r.choice(['post', 'case', 'home'])}"])
    at = r.choice(["@"] * 4 + [" @ ", "[at]", " at "])
    dot = " dot " if at == " at " else "."
    return user + at + r.choice(["inbox", "webmail", "free-net", "office"]) + dot + r.choice(["example", "test", f"my{dot}example"])


def _number(r: random.Random) -> str:
    form = r.random()
    if form < 0.2:
        return r.choice("ABCEGHJKLMPRTX") + str(r.randrange(10**6, 10**8))
    if form < 0.3:
        return r.choice("KLMPRT") + r.choice("KLMPRT") + f" {r.randrange(100, 1000)}.{r.randrange(100, 1000)}"
    if form < 0.4:
        return f"{r.randrange(100, 10000)}/{r.randrange(10, 100)}-{r.choice('ABCDE')}"
    if form < 0.55:
        return _grouped(r, 9, 9, " ")
    if form < 0.75:
        return _grouped(r, r.randint(8, 10), 2, " -")
    return f"{r.randrange(10**5, 10**6)}{r.choice('-+')}{r.randrange(1000, 10**4)}"


def _address_of(r: random.Random, lang: str, town: str) -> str:
    names, kinds = _STREETS[lang]
    n, code = r.randrange(1, 250), r.randrange(1000, 10000)
    letter = r.choice(["", "", "", "a", "b"])
    if lang == "en":
        street = f"{n}{letter} {r.choice(names + [_surname(r)])} {r.choice(kinds)}"
        street = r.choice([street] * 3 + [f"Flat {r.randrange(1, 40)}, {street}", f"No. {street.replace(' ', ', ', 1)}"])
        return street + r.choice(["", f", {town}", f", {town}", f", {town} {code}"])
    if lang == "fr":
        street = f"{n}{r.choice(['', '', ' bis', ' ter'])}{r.choice([',', ''])} {r.choice(kinds)} {r.choice(names + ['de ' + _surname(r)])}"
        return street + r.choice(["", f" à {town}", f", {code} {town}"])
    street = r.choice([r.choice(names + [_surname(r)]) + r.choice(kinds)] * 3 + [f"{r.choice(['Am', 'Zum', 'Im', 'An der'])} {r.choice(['Alten ', 'Neuen ', ''])}{r.choice(['Markt', 'Tor', 'Kirchplatz', 'Graben', 'Ufer'])}"])
    return f"{street} {n}{letter}" + r.choice(["", f" in {town}", f", {code} {town}"])


_MARK = re.compile(r"\[([PATEI])\|((?:[^\[\]]|\[at\])*)\]")
_GERMAN = re.compile(r"\b(der|die|das|ein|eine|und|ist|sie|im|an|zu|am|mit|wohnt|unter|schreiben|rufen|wurde|sagt|steht|seine|ihr|meine|ich|wie|wir)\b", re.I)
_FRENCH = re.compile(r"\b(le|la|les|un|une|du|et|est|au|elle|il|pour|sur|dans|depuis|son|sa|on|je|été|que|chez)\b|[ldnm]'", re.I)


def language(line: str) -> str:
    """en, fr or de, by small words."""
    bare = _MARK.sub(" ", line)
    de, fr = len(_GERMAN.findall(bare)), len(_FRENCH.findall(bare))
    return "de" if de > fr and de > 1 else "fr" if fr > de and fr > 0 else "en"


def expand(towns: list[str], copies: int = 10, seed: int = 11, lines: list[str] | None = None, people: list[tuple[str, str]] = []) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) of every labelled sentence (or of ``lines``) as it stands and in ``copies`` variants.

    ``people`` are the (first name, surname) of the members, whom {M} names; others share first names with them and now and then a surname.
    """
    r, out = random.Random(seed), []
    firsts, known = sorted({f for f, _ in people}), sorted({s for _, s in people})
    towns = towns or ["Wexbridge"]
    for line in lines if lines is not None else TABLE.strip().splitlines():
        lang = language(line)
        for k in range(copies + 1):
            s = re.sub(r"\{C\}", lambda _: r.choice(towns), line)
            s = re.sub(r"\{M\}", lambda _: _member(r, people), s)
            s = re.sub(r"\{D\}", lambda _: str(r.randrange(1, 500)), s)
            s = re.sub(r"\{N\}", lambda _: r.choice([_number(r), _phone(r, lang), _phone(r, lang), str(r.randrange(10**9, 10**10)), f"{r.randrange(1, 500)}-{r.randrange(1, 500)}"]), s)
            text, spans, at = "", [], 0
            for m in _MARK.finditer(s):
                text += s[at : m.start()]
                kind, v = m.groups()
                if k:
                    if kind == "P":
                        v = _surname(r, known) if " " not in v else _person(r, firsts, known)
                    elif kind == "T":
                        v = _phone(r, lang)
                    elif kind == "E":
                        v = _email(r)
                    elif kind == "I":
                        v = _number(r)
                    else:
                        v = _address_of(r, lang, r.choice(towns))
                        if r.random() < 0.15:
                            v = v.replace(", ", ",\n")
                spans.append((len(text), len(text) + len(v), kind))
                text += v
                at = m.end()
            text += s[at:]
            if k and r.random() < 0.15:
                text = text.replace("'", "’")
            out.append((text, spans))
    # neighbours of a sentence vary: three make one example
    r.shuffle(out)
    joined = []
    for i in range(0, len(out), 3):
        text, spans = "", []
        for s, marks in out[i : i + 3]:
            at = len(text) + bool(text)
            text += " " * bool(text) + s
            spans += [(x + at, y + at, k) for x, y, k in marks]
        joined.append((text, spans))
    return joined
