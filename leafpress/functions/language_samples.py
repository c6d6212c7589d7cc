"""Sample texts and frequent words that the language profiles are counted from.

The first of each language is article 1 of the Universal Declaration of Human Rights, the second
everyday sentences of our own.
"""

from __future__ import annotations

import re

# Frequent short words per language.
STOPWORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "von", "ein", "für", "auf", "den"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "was", "are", "this"),
    "es": ("el", "los", "las", "que", "y", "en", "por", "con", "para", "una", "del", "es"),
    "fr": ("le", "les", "des", "et", "est", "dans", "pour", "que", "une", "sur", "avec", "qui"),
}

_MORE = {
    "af": "die en van is nie het dat om vir met ek hy sy wat word aan op te 'n was deur ook maar hulle ons as",
    "ar": "في من على إلى أن عن التي الذي هذا هذه كان مع ما لا هو هي بين بعد ذلك كل قد لم أو ثم كما",
    "be": "і ў на не што з да як гэта яго для па але ад яна быў ён або якія таксама за яны пры было",
    "bg": "и в на за да се от са че по не с как това ще но си или при до като която който беше също",
    "ca": "el la els les de i que en un una per amb no és del al dels són com més però aquest aquesta seva també",
    "cs": "a se v na je že o s do to z i pro by jsem ale jako za po od jeho jsou byl které nebo",
    "da": "og i at det er en til på af som den for de med ikke der et har var jeg han blev også fra eller",
    "de": "im zu dem sich des als auch es an werden aus er hat dass sie nach bei einer um",
    "en": "a it as on be at by he had not but his from or have an they which you were",
    "es": "de la se un no su al lo como más pero sus le ya o este sí porque esta son",
    "et": "ja on ei et see oli ka kui ning mis oma ta aga selle või nii siis veel mida ma ole ainult kes pärast",
    "fa": "و در به از که این را با است برای آن یک خود تا بر هم نیز شده بود شد می ها کرد او ما",
    "fi": "ja on ei että se oli hän mutta ovat kun myös joka niin tai jos kuin sen ole mitä sekä vain olla hänen nyt ne",
    "fr": "la de un en du il au par pas plus se ce ne sont ou son mais nous elle aux",
    "ga": "an agus na ar is a i go le sé do bhí ag sin seo ach as nach mar níos ní bhfuil raibh siad chun",
    "gl": "o a os as de e que en do da un unha non por con para é no na dos das máis como pero ao",
    "hi": "के है में की और से को का एक पर यह हैं ने कि भी नहीं था इस लिए कर हो जो तो ही गया",
    "hr": "i u je na se da za od s su o kao što ne bi ali ili iz koji nije biti samo više bio koja",
    "hu": "a az és hogy nem is egy volt ez de meg azt ezt csak van már mint ha vagy még el lesz ki amely után",
    "id": "yang dan di dengan untuk ini itu dari dalam tidak pada adalah ke akan oleh juga sebagai karena mereka bisa ada atau telah saya kita bahwa kami",
    "is": "og að í á er sem til var við um en það af með fyrir ekki því hann eru ég hún svo þess hefur frá",
    "it": "il di che è e la per un non in una sono del della con i da si le gli al come anche più nel",
    "lt": "ir yra kad į su iš tai bet kaip ne buvo o už jis po apie ar jo tik dar nuo taip iki kurie arba",
    "lv": "un ir ka no uz ar par bet kā tas to ne arī bija lai vai pēc pie kas šo tika tā viņš kad ja",
    "mk": "и во на да се од за не е со што како ги ја но тоа го или по која кој беше ова при исто",
    "mr": "आणि आहे या हे ते की तो होते आहेत ही मध्ये एक त्या नाही होता केली साठी पण व त्यांनी करून ती असे त्याच्या होती",
    "ms": "yang dan di dengan untuk ini itu dari dalam tidak pada adalah ke akan oleh juga sebagai kerana mereka boleh ada atau telah saya ialah bahawa kami",
    "ne": "र छ को मा यो ले हो पनि लागि छन् भने एक तर थियो गर्न बाट त्यो गरेको भएको हुन् उनले गर्ने तथा सो यस",
    "nl": "de het een van en in is dat op te zijn met voor niet die er aan ook als maar om bij door naar werd",
    "no": "og i det er en til på av som for de med ikke at et har var jeg han ble også fra eller seg etter",
    "pl": "i w na z się nie do to że jest jak o po co ale od za czy przez dla był tak jego oraz są",
    "pt": "o a os as de e que em um uma não do da para com por é no na dos das mais se ao foi",
    "ro": "și în de la a cu nu pe că este din o un care pentru mai ce sunt fost au dar sau fi al prin",
    "ru": "и в не на что с он как это по но из за от для то его все она так же или был было при",
    "sk": "a sa v na je že o s do to z aj pre by som ale ako za po od jeho sú bol ktoré alebo",
    "sl": "in je v na se da za so z ki ne pa po bi kot ali o tudi iz s pri ter bil še če",
    "sq": "të e në dhe një për me që nga është i nuk se më ka si u por do kjo ky nje edhe janë ose",
    "sr": "и у је на се да за од су са о као што не би али или из који није бити само више био која",
    "sv": "och i att det är en som på av för med den till inte ett har de om var jag han men så från eller",
    "sw": "ya na wa kwa ni katika la za kuwa hii kama cha huo yake au lakini hiyo huyo pia si mtu watu hivyo kila sana",
    "tl": "ang ng sa na mga at ay si ito para hindi ko kung may mo siya niya ni kanyang nang ako rin isang o din",
    "tr": "ve bir bu da için de ile olarak çok daha o ne gibi olan ama var kadar sonra değil en ki mi ya her veya",
    "uk": "і в на не що з та до як це його для за по але від вона був він або які також про було при",
    "ur": "کے ہے میں کی اور سے کو کا ایک پر یہ ہیں نے کہ بھی نہیں تھا اس لیے کر ہو جو تو ہی گیا",
    "vi": "và của là có được trong cho không một các với này người đã những khi để đến từ cũng như tại vào ra bị",
}

#: Frequent words of every language that n-grams are counted for, most frequent first.
COMMON = {lang: tuple(dict.fromkeys((*STOPWORDS.get(lang, ()), *re.findall(r"[^\W\d_][^\s']*", words)))) for lang, words in sorted(_MORE.items())}

# Texts by language code.
SAMPLES = {
    "af": (
        "Alle menslike wesens word vry, met gelyke waardigheid en regte, gebore. Hulle het rede en gewete en behoort in die gees van broederskap teenoor mekaar op te tree.",
        "Ek weet nie waarom hy gister nie gekom het nie, maar sy vrou het gesê dat hulle vandag weer na die stad toe gaan om brood, melk en vleis te koop. Die kinders speel in die tuin en die son skyn die hele dag.",
    ),
    "ar": (
        "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق، وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء.",
        "ذهب الأولاد إلى المدرسة في الصباح ثم عادوا إلى البيت بعد الظهر، وقالت أمهم إن الطعام جاهز وإن أباهم سوف يصل من العمل في المساء لأن الطريق كان مزدحماً جداً هذا اليوم.",
    ),
    "be": (
        "Усе людзі нараджаюцца свабоднымі і роўнымі ў сваёй годнасці і правах. Яны надзелены розумам і сумленнем і павінны ставіцца адзін да аднаго ў духу брацтва.",
        "Учора мы хадзілі ў горад, каб купіць хлеб і малако, але крама была зачынена, таму што была нядзеля. Дзеці гулялі каля ракі, а вечарам бацька вярнуўся з працы і расказаў ім казку.",
    ),
    "bg": (
        "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство.",
        "Вчера отидохме в града, за да купим хляб и мляко, но магазинът беше затворен, защото беше неделя. Децата играеха край реката, а вечерта баща им се върна от работа и им разказа приказка.",
    ),
    "ca": (
        "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i han de comportar-se fraternalment els uns amb els altres.",
        "Ahir vam anar a la ciutat per comprar pa i llet, però la botiga era tancada perquè era diumenge. Els nens jugaven prop del riu i al vespre el seu pare va tornar de la feina i els va explicar un conte molt bonic.",
    ),
    "cs": (
        "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
        "Včera jsme šli do města, abychom koupili chléb a mléko, ale obchod byl zavřený, protože byla neděle. Děti si hrály u řeky a večer se jejich otec vrátil z práce a vyprávěl jim pohádku. Kdybych to věděl dříve, přišel bych s vámi.",
    ),
    "da": (
        "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.",
        "I går gik vi ind til byen for at købe brød og mælk, men butikken var lukket, fordi det var søndag. Børnene legede ved åen, og om aftenen kom deres far hjem fra arbejde og fortalte dem en historie. Jeg ved ikke, hvad der skete, men nogle af dem blev nødt til at blive hjemme uden mig.",
    ),
    "de": (
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
        "Gestern gingen wir in die Stadt, um Brot und Milch zu kaufen, aber der Laden war geschlossen, weil es Sonntag war. Die Kinder spielten am Fluss, und am Abend kam ihr Vater von der Arbeit zurück und erzählte ihnen eine Geschichte.",
    ),
    "en": (
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
        "Yesterday we went into town to buy bread and milk, but the shop was closed because it was Sunday. The children played by the river, and in the evening their father came back from work and told them a story.",
    ),
    "es": (
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
        "Ayer fuimos a la ciudad para comprar pan y leche, pero la tienda estaba cerrada porque era domingo. Los niños jugaban cerca del río y por la noche su padre volvió del trabajo y les contó un cuento muy bonito.",
    ),
    "et": (
        "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim.",
        "Eile läksime linna, et osta leiba ja piima, aga pood oli kinni, sest oli pühapäev. Lapsed mängisid jõe ääres ja õhtul tuli nende isa töölt koju ning rääkis neile ühe ilusa loo.",
    ),
    "fa": (
        "تمام افراد بشر آزاد به دنیا می‌آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان هستند و باید نسبت به یکدیگر با روح برادری رفتار کنند.",
        "دیروز به شهر رفتیم تا نان و شیر بخریم، ولی مغازه بسته بود چون جمعه بود. بچه‌ها کنار رودخانه بازی می‌کردند و شب پدرشان از سر کار برگشت و برای آنها قصه‌ای گفت که خیلی زیبا بود.",
    ),
    "fi": (
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Eilen menimme kaupunkiin ostamaan leipää ja maitoa, mutta kauppa oli kiinni, koska oli sunnuntai. Lapset leikkivät joen rannalla, ja illalla heidän isänsä tuli töistä kotiin ja kertoi heille kauniin tarinan.",
    ),
    "fr": (
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
        "Hier, nous sommes allés en ville pour acheter du pain et du lait, mais le magasin était fermé parce que c'était dimanche. Les enfants jouaient au bord de la rivière et le soir leur père est rentré du travail et leur a raconté une histoire.",
    ),
    "ga": (
        "Saolaítear na daoine uile saor agus comhionann ina ndínit agus ina gcearta. Tá bua an réasúin agus an choinsiasa acu agus dlíd gníomhú i dtreo a chéile i spiorad an bhráithreachais.",
        "Chuamar isteach sa bhaile mór inné chun arán agus bainne a cheannach, ach bhí an siopa dúnta mar ba é an Domhnach a bhí ann. Bhí na páistí ag súgradh in aice na habhann agus tháinig a n-athair abhaile ón obair tráthnóna.",
    ),
    "gl": (
        "Tódolos seres humanos nacen libres e iguais en dignidade e dereitos e, dotados como están de razón e conciencia, débense comportar fraternalmente uns cos outros.",
        "Onte fomos á cidade para mercar pan e leite, pero a tenda estaba pechada porque era domingo. Os nenos xogaban a carón do río e pola noite o seu pai volveu do traballo e contoulles unha historia moi fermosa. Hoxe xa non hai xente na rúa.",
    ),
    "hi": (
        "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
        "कल हम रोटी और दूध खरीदने के लिए शहर गए थे, लेकिन दुकान बंद थी क्योंकि रविवार था। बच्चे नदी के किनारे खेल रहे थे और शाम को उनके पिता काम से लौटे और उन्हें एक कहानी सुनाई।",
    ),
    "hr": (
        "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva.",
        "Jučer smo išli u grad kupiti kruh i mlijeko, ali trgovina je bila zatvorena jer je bila nedjelja. Djeca su se igrala kraj rijeke, a navečer se njihov otac vratio s posla i ispričao im priču. Tko će znati što se dogodilo i gdje je sada.",
    ),
    "hu": (
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
        "Tegnap bementünk a városba, hogy kenyeret és tejet vegyünk, de a bolt zárva volt, mert vasárnap volt. A gyerekek a folyó mellett játszottak, este pedig az apjuk hazajött a munkából és mesélt nekik egy szép történetet.",
    ),
    "id": (
        "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
        "Kemarin kami pergi ke kota untuk membeli roti dan susu, tetapi tokonya tutup karena hari Minggu. Anak-anak bermain di tepi sungai dan malamnya ayah mereka pulang dari kantor dan bercerita. Mobil itu sangat mahal, karena itu saya naik sepeda saja. Bisa jadi uang itu sudah habis, kata beliau kepada polisi.",
    ),
    "is": (
        "Hver maður er borinn frjáls og jafn öðrum að virðingu og réttindum. Menn eru gæddir vitsmunum og samvizku, og ber þeim að breyta bróðurlega hverjum við annan.",
        "Í gær fórum við í bæinn til að kaupa brauð og mjólk, en búðin var lokuð af því að það var sunnudagur. Börnin léku sér við ána og um kvöldið kom faðir þeirra heim úr vinnunni og sagði þeim sögu.",
    ),
    "it": (
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
        "Ieri siamo andati in città per comprare pane e latte, ma il negozio era chiuso perché era domenica. I bambini giocavano vicino al fiume e la sera il loro padre è tornato dal lavoro e ha raccontato loro una storia.",
    ),
    "lt": (
        "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai.",
        "Vakar nuėjome į miestą nusipirkti duonos ir pieno, bet parduotuvė buvo uždaryta, nes buvo sekmadienis. Vaikai žaidė prie upės, o vakare jų tėvas grįžo iš darbo ir papasakojo jiems pasaką.",
    ),
    "lv": (
        "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā.",
        "Vakar mēs gājām uz pilsētu, lai nopirktu maizi un pienu, bet veikals bija slēgts, jo bija svētdiena. Bērni spēlējās pie upes, un vakarā viņu tēvs atgriezās no darba un izstāstīja viņiem stāstu.",
    ),
    "mk": (
        "Сите човечки суштества се раѓаат слободни и еднакви по достоинство и права. Тие се обдарени со разум и совест и треба да се однесуваат еден кон друг во духот на општочовечката припадност.",
        "Вчера отидовме во градот за да купиме леб и млеко, но продавницата беше затворена бидејќи беше недела. Децата играа покрај реката, а вечерта нивниот татко се врати од работа и им раскажа приказна.",
    ),
    "mr": (
        "सर्व मानवी व्यक्ति जन्मतःच स्वतंत्र आहेत व त्यांना समान प्रतिष्ठा व समान अधिकार आहेत. त्यांना विचारशक्ति व सदसद्विवेकबुद्धि लाभलेली आहे व त्यांनी एकमेकांशी बंधुत्वाच्या भावनेने आचरण करावे.",
        "काल आम्ही भाकरी आणि दूध विकत घेण्यासाठी शहरात गेलो होतो, पण रविवार असल्यामुळे दुकान बंद होते. मुले नदीच्या काठावर खेळत होती आणि संध्याकाळी त्यांचे वडील कामावरून परत आले व त्यांनी एक गोष्ट सांगितली.",
    ),
    "ms": (
        "Semua manusia dilahirkan bebas dan sama rata dari segi maruah dan hak-hak. Mereka mempunyai pemikiran dan perasaan hati dan hendaklah bertindak di antara satu sama lain dengan semangat persaudaraan.",
        "Semalam kami pergi ke bandar untuk membeli roti dan susu, tetapi kedai itu ditutup kerana hari Ahad. Kanak-kanak bermain di tepi sungai dan pada waktu malam bapa mereka pulang dari pejabat dan bercerita. Kereta itu sangat mahal, oleh itu saya menaiki basikal sahaja. Boleh jadi wang itu telah habis, kata beliau kepada pihak polis.",
    ),
    "ne": (
        "सबै व्यक्तिहरू जन्मजात स्वतन्त्र हुन् ती सबैको समान अधिकार र महत्व छ। निजहरूमा विचार शक्ति र सद्विचार भएकोले निजहरूले आपसमा भातृत्वको भावनाबाट व्यवहार गर्नु पर्छ।",
        "हिजो हामी रोटी र दूध किन्न शहर गएका थियौं, तर आइतबार भएकोले पसल बन्द थियो। केटाकेटीहरू नदी किनारमा खेलिरहेका थिए र बेलुका उनीहरूका बुबा कामबाट फर्केर एउटा कथा सुनाउनुभयो।",
    ),
    "nl": (
        "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
        "Gisteren gingen we naar de stad om brood en melk te kopen, maar de winkel was gesloten omdat het zondag was. De kinderen speelden bij de rivier en 's avonds kwam hun vader terug van zijn werk en vertelde hij hun een verhaal.",
    ),
    "no": (
        "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd.",
        "I går gikk vi inn til byen for å kjøpe brød og melk, men butikken var stengt fordi det var søndag. Barna lekte ved elven, og om kvelden kom faren deres hjem fra jobb og fortalte dem en historie. Jeg vet ikke hva som skjedde, men noen av dem ble nødt til å bli hjemme uten meg.",
    ),
    "pl": (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Wczoraj poszliśmy do miasta, żeby kupić chleb i mleko, ale sklep był zamknięty, ponieważ była niedziela. Dzieci bawiły się nad rzeką, a wieczorem ich ojciec wrócił z pracy i opowiedział im bajkę.",
    ),
    "pt": (
        "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
        "Ontem fomos à cidade para comprar pão e leite, mas a loja estava fechada porque era domingo. As crianças brincavam perto do rio e à noite o pai delas voltou do trabalho e contou-lhes uma história muito bonita. Hoje já não há gente na rua, então ele ficou em casa.",
    ),
    "ro": (
        "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
        "Ieri am mers în oraș ca să cumpărăm pâine și lapte, dar magazinul era închis pentru că era duminică. Copiii se jucau lângă râu, iar seara tatăl lor s-a întors de la muncă și le-a spus o poveste.",
    ),
    "ru": (
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "Вчера мы ходили в город, чтобы купить хлеб и молоко, но магазин был закрыт, потому что было воскресенье. Дети играли у реки, а вечером их отец вернулся с работы и рассказал им сказку.",
    ),
    "sk": (
        "Všetci ľudia sa rodia slobodní a rovní v dôstojnosti i právach. Sú obdarení rozumom a svedomím a majú sa k sebe správať v bratskom duchu.",
        "Včera sme išli do mesta, aby sme kúpili chlieb a mlieko, ale obchod bol zatvorený, pretože bola nedeľa. Deti sa hrali pri rieke a večer sa ich otec vrátil z práce a rozprával im rozprávku. Keby som to vedel skôr, prišiel by som s vami.",
    ),
    "sl": (
        "Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice. Obdarjeni so z razumom in vestjo in bi morali ravnati drug z drugim kakor bratje.",
        "Včeraj smo šli v mesto, da bi kupili kruh in mleko, vendar je bila trgovina zaprta, ker je bila nedelja. Otroci so se igrali ob reki, zvečer pa se je njihov oče vrnil iz službe in jim povedal zgodbo. Kdo bi vedel, kaj se je zgodilo in kje je zdaj.",
    ),
    "sq": (
        "Të gjithë njerëzit lindin të lirë dhe të barabartë në dinjitet dhe në të drejta. Ata kanë arsye dhe ndërgjegje dhe duhet të sillen ndaj njëri tjetrit me frymë vëllazërimi.",
        "Dje shkuam në qytet për të blerë bukë dhe qumësht, por dyqani ishte i mbyllur sepse ishte e diel. Fëmijët luanin pranë lumit dhe në mbrëmje babai i tyre u kthye nga puna dhe u tregoi një përrallë.",
    ),
    "sr": (
        "Сва људска бића рађају се слободна и једнака у достојанству и правима. Она су обдарена разумом и свешћу и треба једни према другима да поступају у духу братства.",
        "Јуче смо ишли у град да купимо хлеб и млеко, али продавница је била затворена јер је била недеља. Деца су се играла поред реке, а увече се њихов отац вратио с посла и испричао им причу.",
    ),
    "sv": (
        "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap.",
        "I går gick vi in till staden för att köpa bröd och mjölk, men affären var stängd eftersom det var söndag. Barnen lekte vid ån och på kvällen kom deras pappa hem från jobbet och berättade en saga för dem.",
    ),
    "sw": (
        "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
        "Jana tulikwenda mjini kununua mkate na maziwa, lakini duka lilikuwa limefungwa kwa sababu ilikuwa Jumapili. Watoto walicheza kando ya mto na jioni baba yao alirudi kutoka kazini akawaambia hadithi nzuri.",
    ),
    "tl": (
        "Ang lahat ng tao'y isinilang na malaya at pantay-pantay sa karangalan at mga karapatan. Sila'y pinagkalooban ng katwiran at budhi at dapat magpalagayan ang isa't isa sa diwa ng pagkakapatiran.",
        "Kahapon ay pumunta kami sa bayan upang bumili ng tinapay at gatas, ngunit sarado ang tindahan dahil Linggo noon. Naglaro ang mga bata sa tabi ng ilog at kinagabihan ay umuwi ang kanilang ama mula sa trabaho at nagkuwento sa kanila.",
    ),
    "tr": (
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "Dün ekmek ve süt almak için şehre gittik, ama pazar günü olduğu için dükkân kapalıydı. Çocuklar nehrin kenarında oynadılar ve akşam babaları işten dönüp onlara güzel bir hikâye anlattı.",
    ),
    "uk": (
        "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
        "Учора ми ходили до міста, щоб купити хліб і молоко, але крамниця була зачинена, бо була неділя. Діти гралися біля річки, а ввечері їхній батько повернувся з роботи й розповів їм казку.",
    ),
    "ur": (
        "تمام انسان آزاد اور حقوق و عزت کے اعتبار سے برابر پیدا ہوئے ہیں۔ انہیں ضمیر اور عقل ودیعت ہوئی ہے۔ اس لئے انہیں ایک دوسرے کے ساتھ بھائی چارے کا سلوک کرنا چاہیئے۔",
        "کل ہم روٹی اور دودھ خریدنے کے لیے شہر گئے تھے، لیکن دکان بند تھی کیونکہ اتوار تھا۔ بچے دریا کے کنارے کھیل رہے تھے اور شام کو ان کے والد کام سے واپس آئے اور انہیں ایک کہانی سنائی۔",
    ),
    "vi": (
        "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
        "Hôm qua chúng tôi vào thành phố để mua bánh mì và sữa, nhưng cửa hàng đóng cửa vì là chủ nhật. Bọn trẻ chơi bên bờ sông và buổi tối cha của chúng đi làm về rồi kể cho chúng nghe một câu chuyện.",
    ),
}
