"""Sentences that no profile was counted from, a few for each language, to measure recall."""

SENTENCES = {
    "af": ["Die vergadering is uitgestel omdat die voorsitter siek geword het.", "Ons het 'n nuwe huis gekoop wat naby die see is.", "Kan jy my asseblief help om hierdie deur oop te maak?"],
    "ar": ["أعلنت الحكومة عن خطة جديدة لتحسين المستشفيات في المدن الكبرى.", "لا أعرف لماذا تأخر القطار هذا الصباح.", "يحب أخي قراءة الكتب القديمة قبل النوم."],
    "be": ["Урад абвясціў пра новы план паляпшэння бальніц у вялікіх гарадах.", "Я не ведаю, чаму цягнік спазніўся сёння раніцай.", "Мой брат любіць чытаць старыя кнігі перад сном."],
    "bg": ["Правителството обяви нов план за подобряване на болниците в големите градове.", "Не знам защо влакът закъсня тази сутрин.", "Брат ми обича да чете стари книги преди сън."],
    "ca": ["El govern ha anunciat un nou pla per millorar els hospitals de les grans ciutats.", "No sé per què el tren ha arribat tard aquest matí.", "Al meu germà li agrada llegir llibres antics abans de dormir."],
    "cs": ["Vláda oznámila nový plán na zlepšení nemocnic ve velkých městech.", "Nevím, proč měl dnes ráno vlak zpoždění.", "Můj bratr rád čte staré knihy, než jde spát."],
    "da": ["Regeringen har fremlagt en ny plan for at forbedre sygehusene i de store byer.", "Jeg ved ikke, hvorfor toget var forsinket i morges.", "Min bror kan godt lide at læse gamle bøger, før han går i seng."],
    "de": ["Die Regierung hat einen neuen Plan zur Verbesserung der Krankenhäuser in den großen Städten angekündigt.", "Ich weiß nicht, warum der Zug heute Morgen Verspätung hatte.", "Mein Bruder liest vor dem Schlafen gern alte Bücher."],
    "en": ["The government announced a new plan to improve hospitals in large cities.", "I do not know why the train was late this morning.", "My brother likes reading old books before he goes to sleep."],
    "es": ["El gobierno anunció un nuevo plan para mejorar los hospitales de las grandes ciudades.", "No sé por qué el tren llegó tarde esta mañana.", "A mi hermano le gusta leer libros antiguos antes de dormir."],
    "et": ["Valitsus teatas uuest kavast parandada suurte linnade haiglaid.", "Ma ei tea, miks rong täna hommikul hilines.", "Mu vennale meeldib enne magamaminekut vanu raamatuid lugeda."],
    "fa": ["دولت برنامه تازه‌ای برای بهبود بیمارستان‌های شهرهای بزرگ اعلام کرد.", "نمی‌دانم چرا قطار امروز صبح دیر کرد.", "برادرم دوست دارد پیش از خواب کتاب‌های قدیمی بخواند."],
    "fi": ["Hallitus ilmoitti uudesta suunnitelmasta parantaa suurten kaupunkien sairaaloita.", "En tiedä, miksi juna oli tänä aamuna myöhässä.", "Veljeni lukee mielellään vanhoja kirjoja ennen nukkumaanmenoa."],
    "fr": ["Le gouvernement a annoncé un nouveau plan pour améliorer les hôpitaux des grandes villes.", "Je ne sais pas pourquoi le train était en retard ce matin.", "Mon frère aime lire de vieux livres avant de dormir."],
    "ga": ["D'fhógair an rialtas plean nua chun na hospidéil sna cathracha móra a fheabhsú.", "Níl a fhios agam cén fáth a raibh an traein déanach ar maidin.", "Is maith le mo dheartháir seanleabhair a léamh sula dtéann sé a chodladh."],
    "gl": ["O goberno anunciou un novo plan para mellorar os hospitais das grandes cidades.", "Non sei por que o tren chegou tarde esta mañá.", "Ao meu irmán gústalle ler libros vellos antes de durmir."],
    "hi": ["सरकार ने बड़े शहरों के अस्पतालों को सुधारने की नई योजना की घोषणा की।", "मुझे नहीं पता कि आज सुबह ट्रेन देर से क्यों आई।", "मेरे भाई को सोने से पहले पुरानी किताबें पढ़ना पसंद है।"],
    "hr": ["Vlada je najavila novi plan za poboljšanje bolnica u velikim gradovima.", "Ne znam zašto je vlak jutros kasnio.", "Moj brat voli čitati stare knjige prije spavanja."],
    "hu": ["A kormány új tervet jelentett be a nagyvárosi kórházak fejlesztésére.", "Nem tudom, miért késett ma reggel a vonat.", "A bátyám szeret régi könyveket olvasni lefekvés előtt."],
    "id": ["Pemerintah mengumumkan rencana baru untuk memperbaiki rumah sakit di kota-kota besar.", "Saya tidak tahu mengapa kereta api terlambat tadi pagi.", "Kakak saya suka membaca buku tua sebelum tidur karena bisa membuatnya tenang."],
    "is": ["Ríkisstjórnin kynnti nýja áætlun um að bæta sjúkrahús í stórum borgum.", "Ég veit ekki af hverju lestin var sein í morgun.", "Bróður mínum finnst gaman að lesa gamlar bækur áður en hann fer að sofa."],
    "it": ["Il governo ha annunciato un nuovo piano per migliorare gli ospedali delle grandi città.", "Non so perché il treno fosse in ritardo questa mattina.", "A mio fratello piace leggere vecchi libri prima di dormire."],
    "lt": ["Vyriausybė paskelbė naują planą didžiųjų miestų ligoninėms gerinti.", "Nežinau, kodėl traukinys šįryt vėlavo.", "Mano brolis mėgsta prieš miegą skaityti senas knygas."],
    "lv": ["Valdība paziņoja par jaunu plānu uzlabot slimnīcas lielajās pilsētās.", "Es nezinu, kāpēc vilciens šorīt kavējās.", "Manam brālim patīk pirms gulētiešanas lasīt vecas grāmatas."],
    "mk": ["Владата објави нов план за подобрување на болниците во големите градови.", "Не знам зошто возот доцнеше утрово.", "Брат ми сака да чита стари книги пред спиење."],
    "mr": ["सरकारने मोठ्या शहरांतील रुग्णालये सुधारण्यासाठी नवीन योजना जाहीर केली.", "आज सकाळी गाडी उशिरा का आली हे मला माहीत नाही.", "माझ्या भावाला झोपण्यापूर्वी जुनी पुस्तके वाचायला आवडतात."],
    "ms": ["Kerajaan mengumumkan rancangan baharu untuk memperbaiki hospital di bandar-bandar besar.", "Saya tidak tahu kenapa kereta api lewat pagi tadi.", "Abang saya suka membaca buku lama sebelum tidur kerana ia boleh menenangkan fikirannya."],
    "ne": ["सरकारले ठूला शहरका अस्पताल सुधार गर्न नयाँ योजना घोषणा गरेको छ।", "आज बिहान रेल किन ढिलो आयो मलाई थाहा छैन।", "मेरो भाइलाई सुत्नुअघि पुराना किताब पढ्न मन पर्छ।"],
    "nl": ["De regering heeft een nieuw plan aangekondigd om de ziekenhuizen in grote steden te verbeteren.", "Ik weet niet waarom de trein vanmorgen te laat was.", "Mijn broer leest graag oude boeken voordat hij gaat slapen."],
    "no": ["Regjeringen har lagt frem en ny plan for å forbedre sykehusene i de store byene.", "Jeg vet ikke hvorfor toget var forsinket i dag tidlig.", "Broren min liker å lese gamle bøker før han legger seg."],
    "pl": ["Rząd ogłosił nowy plan poprawy szpitali w dużych miastach.", "Nie wiem, dlaczego pociąg spóźnił się dziś rano.", "Mój brat lubi czytać stare książki przed snem."],
    "pt": ["O governo anunciou um novo plano para melhorar os hospitais das grandes cidades.", "Não sei por que o comboio chegou atrasado esta manhã.", "O meu irmão gosta de ler livros antigos antes de dormir."],
    "ro": ["Guvernul a anunțat un nou plan pentru îmbunătățirea spitalelor din marile orașe.", "Nu știu de ce a întârziat trenul în această dimineață.", "Fratelui meu îi place să citească cărți vechi înainte de culcare."],
    "ru": ["Правительство объявило о новом плане улучшения больниц в крупных городах.", "Я не знаю, почему поезд опоздал сегодня утром.", "Мой брат любит читать старые книги перед сном."],
    "sk": ["Vláda oznámila nový plán na zlepšenie nemocníc vo veľkých mestách.", "Neviem, prečo dnes ráno vlak meškal.", "Môj brat rád číta staré knihy predtým, než ide spať."],
    "sl": ["Vlada je napovedala nov načrt za izboljšanje bolnišnic v velikih mestih.", "Ne vem, zakaj je vlak danes zjutraj zamujal.", "Moj brat rad bere stare knjige, preden gre spat."],
    "sq": ["Qeveria njoftoi një plan të ri për të përmirësuar spitalet në qytetet e mëdha.", "Nuk e di pse treni u vonua sot në mëngjes.", "Vëllai im pëlqen të lexojë libra të vjetër para gjumit."],
    "sr": ["Влада је најавила нови план за побољшање болница у великим градовима.", "Не знам зашто је воз јутрос каснио.", "Мој брат воли да чита старе књиге пре спавања."],
    "sv": ["Regeringen presenterade en ny plan för att förbättra sjukhusen i de stora städerna.", "Jag vet inte varför tåget var försenat i morse.", "Min bror tycker om att läsa gamla böcker innan han somnar."],
    "sw": ["Serikali ilitangaza mpango mpya wa kuboresha hospitali katika miji mikubwa.", "Sijui kwa nini treni ilichelewa asubuhi ya leo.", "Kaka yangu anapenda kusoma vitabu vya zamani kabla ya kulala."],
    "tl": ["Inanunsyo ng pamahalaan ang bagong plano upang mapabuti ang mga ospital sa malalaking lungsod.", "Hindi ko alam kung bakit nahuli ang tren kaninang umaga.", "Mahilig magbasa ng mga lumang libro ang kapatid ko bago matulog."],
    "tr": ["Hükümet büyük şehirlerdeki hastaneleri iyileştirmek için yeni bir plan açıkladı.", "Bu sabah trenin neden geciktiğini bilmiyorum.", "Kardeşim uyumadan önce eski kitapları okumayı seviyor."],
    "uk": ["Уряд оголосив про новий план поліпшення лікарень у великих містах.", "Я не знаю, чому потяг запізнився сьогодні вранці.", "Мій брат любить читати старі книжки перед сном."],
    "ur": ["حکومت نے بڑے شہروں کے ہسپتالوں کو بہتر بنانے کے لیے نئے منصوبے کا اعلان کیا۔", "مجھے نہیں معلوم کہ آج صبح ٹرین دیر سے کیوں آئی۔", "میرے بھائی کو سونے سے پہلے پرانی کتابیں پڑھنا پسند ہے۔"],
    "vi": ["Chính phủ đã công bố kế hoạch mới nhằm cải thiện các bệnh viện ở những thành phố lớn.", "Tôi không biết vì sao sáng nay tàu đến muộn.", "Anh trai tôi thích đọc sách cũ trước khi ngủ."],
}
