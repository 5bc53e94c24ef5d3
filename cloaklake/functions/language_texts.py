"""What the language profiles are counted from: a few everyday sentences of each language, as people write to each other."""

from __future__ import annotations

TEXTS: dict[str, str] = {
    "en": "hello how are you today i am fine thank you what is your name my name is good morning good night see you tomorrow can you help me please i would like to know where the house is we have been waiting for them all day long she said that they should not go there because it was too late do you want something to eat yes no maybe i love you very much this is the best thing about our work people think that nothing will change when you write the answer to my question could you tell me which one should be done first",
    "de": "hallo wie geht es dir heute mir geht es gut danke schön wie heißt du ich heiße guten morgen gute nacht bis morgen kannst du mir bitte helfen ich möchte wissen wo das haus ist wir haben den ganzen tag auf sie gewartet sie sagte dass man nicht dorthin gehen sollte weil es zu spät war willst du etwas essen ja nein vielleicht ich liebe dich sehr das ist das beste an unserer arbeit menschen glauben dass sich nichts ändern wird wenn du mir auf meine frage eine antwort schreibst könntest du mir sagen welche zuerst gemacht werden soll freundlichen grüßen auch schon noch über zwischen",
    "fr": "bonjour comment allez vous aujourd hui je vais bien merci beaucoup comment tu t appelles je m appelle bonne nuit à demain peux tu m aider s il te plaît je voudrais savoir où est la maison nous avons attendu toute la journée elle a dit qu ils ne devaient pas y aller parce que c était trop tard veux tu manger quelque chose oui non peut être je t aime beaucoup c est la meilleure chose de notre travail les gens pensent que rien ne changera quand vous écrivez la réponse à ma question je suis content d être avec vous très heureux mais aussi toujours leurs ils sont chez nous avec plaisir cette année",
    "es": "hola cómo estás hoy estoy bien muchas gracias cómo te llamas me llamo buenos días buenas noches hasta mañana puedes ayudarme por favor quisiera saber dónde está la casa hemos esperado todo el día ella dijo que no debían ir allí porque era demasiado tarde quieres comer algo sí no quizás te quiero mucho esto es lo mejor de nuestro trabajo la gente piensa que nada cambiará cuando usted escribe la respuesta a mi pregunta qué tal amigo señor años también después ahora siempre hacer tiene puede muy bien cuando llegue el niño pequeño información corazón",
    "it": "ciao come stai oggi sto bene grazie mille come ti chiami mi chiamo buongiorno buona notte a domani puoi aiutarmi per favore vorrei sapere dove si trova la casa abbiamo aspettato tutto il giorno lei ha detto che non dovevano andare perché era troppo tardi vuoi mangiare qualcosa sì no forse ti amo molto questa è la cosa migliore del nostro lavoro la gente pensa che niente cambierà quando scrivi la risposta alla mia domanda sono contento di essere qui con voi anche più sempre ancora nella degli alle quello ragazzi bella giornata",
    "nl": "hallo hoe gaat het vandaag met je het gaat goed dank je wel hoe heet je ik heet goedemorgen goede nacht tot morgen kun je me alsjeblieft helpen ik wil graag weten waar het huis is we hebben de hele dag op hen gewacht zij zei dat ze daar niet naartoe moesten gaan omdat het te laat was wil je iets eten ja nee misschien ik hou heel veel van jou dit is het beste van ons werk de mensen denken dat er niets zal veranderen wanneer u het antwoord op mijn vraag schrijft zou je mij kunnen zeggen welke eerst gedaan moet worden ook nog altijd zijn jullie blij lekker",
    "pt": "olá como você está hoje estou bem muito obrigado como te chamas meu nome é bom dia boa noite até amanhã pode me ajudar por favor gostaria de saber onde fica a casa nós esperamos o dia todo ela disse que eles não deviam ir lá porque era tarde demais você quer comer alguma coisa sim não talvez eu te amo muito isto é a melhor coisa do nosso trabalho as pessoas pensam que nada vai mudar quando o senhor escreve a resposta à minha pergunta então também depois agora sempre fazer tem pode são coração informação mãe irmão ainda já",
    "pl": "cześć jak się masz dzisiaj dobrze dziękuję bardzo jak masz na imię mam na imię dzień dobry dobranoc do jutra czy możesz mi pomóc proszę chciałbym wiedzieć gdzie jest dom czekaliśmy na nich cały dzień ona powiedziała że nie powinni tam iść ponieważ było już za późno czy chcesz coś zjeść tak nie może kocham cię bardzo to jest najlepsza rzecz w naszej pracy ludzie myślą że nic się nie zmieni kiedy pan napisze odpowiedź na moje pytanie przez wszystko tylko jeszcze więc także który żeby",
    "sv": "hej hur mår du idag jag mår bra tack så mycket vad heter du jag heter god morgon god natt vi ses i morgon kan du hjälpa mig snälla jag skulle vilja veta var huset ligger vi har väntat på dem hela dagen hon sade att de inte borde gå dit eftersom det var för sent vill du äta något ja nej kanske jag älskar dig mycket det här är det bästa med vårt arbete människor tror att ingenting kommer att förändras när du skriver svaret på min fråga också alltid några över under efter mellan måste",
    "no": "hei hvordan har du det i dag jeg har det bra tusen takk hva heter du jeg heter god morgen god natt vi ses i morgen kan du hjelpe meg vær så snill jeg vil gjerne vite hvor huset er vi har ventet på dem hele dagen hun sa at de ikke burde gå dit fordi det var for sent vil du ha noe å spise ja nei kanskje jeg elsker deg veldig mye dette er det beste med arbeidet vårt folk tror at ingenting kommer til å endre seg når du skriver svaret på spørsmålet mitt også alltid noen over etter mellom må bare selv",
    "da": "hej hvordan har du det i dag jeg har det godt mange tak hvad hedder du jeg hedder god morgen godnat vi ses i morgen kan du hjælpe mig vær så venlig jeg vil gerne vide hvor huset er vi har ventet på dem hele dagen hun sagde at de ikke burde gå derhen fordi det var for sent vil du have noget at spise ja nej måske jeg elsker dig meget højt dette er det bedste ved vores arbejde folk tror at intet vil ændre sig når du skriver svaret på mit spørgsmål også altid nogle over efter mellem kun selv uge",
    "fi": "hei mitä sinulle kuuluu tänään minulle kuuluu hyvää kiitos paljon mikä sinun nimesi on minun nimeni on hyvää huomenta hyvää yötä nähdään huomenna voitko auttaa minua ole hyvä haluaisin tietää missä talo on olemme odottaneet heitä koko päivän hän sanoi että heidän ei pitäisi mennä sinne koska oli liian myöhäistä haluatko syödä jotain kyllä ei ehkä minä rakastan sinua hyvin paljon tämä on paras asia työssämme ihmiset ajattelevat ettei mikään muutu kun kirjoitat vastauksen kysymykseeni myös aina vielä kanssa",
    "ca": "hola com estàs avui estic bé moltes gràcies com et dius em dic bon dia bona nit fins demà em pots ajudar si us plau voldria saber on és la casa hem esperat tot el dia ella va dir que no hi havien d anar perquè era massa tard vols menjar alguna cosa sí no potser t estimo molt això és el millor de la nostra feina la gent pensa que res no canviarà quan vostè escriu la resposta a la meva pregunta també després ara sempre fer té pot aquests anys amb els nens petits nosaltres il·lusió",
    "ro": "bună ce mai faci astăzi sunt bine mulțumesc mult cum te cheamă mă numesc bună dimineața noapte bună pe mâine poți să mă ajuți te rog aș vrea să știu unde este casa i am așteptat toată ziua ea a spus că nu trebuie să meargă acolo pentru că era prea târziu vrei să mănânci ceva da nu poate te iubesc foarte mult acesta este cel mai bun lucru din munca noastră oamenii cred că nimic nu se va schimba când scrieți răspunsul la întrebarea mea și întotdeauna încă dacă fără pot fi către",
    "hr": "bok kako si danas dobro sam hvala lijepa kako se zoveš zovem se dobro jutro laku noć vidimo se sutra možeš li mi pomoći molim te htio bih znati gdje je kuća čekali smo ih cijeli dan ona je rekla da ne bi trebali ići tamo jer je bilo prekasno želiš li nešto jesti da ne možda volim te jako puno ovo je najbolja stvar u našem poslu ljudi misle da se ništa neće promijeniti kada napišete odgovor na moje pitanje također uvijek još između nakon prije treba mogu",
    "sl": "živijo kako si danes dobro sem hvala lepa kako ti je ime ime mi je dobro jutro lahko noč se vidiva jutri mi lahko pomagaš prosim rad bi vedel kje je hiša čakali smo jih ves dan rekla je da ne bi smeli iti tja ker je bilo prepozno ali želiš kaj jesti da ne mogoče zelo te ljubim to je najboljša stvar pri našem delu ljudje mislijo da se nič ne bo spremenilo ko boste napisali odgovor na moje vprašanje tudi vedno še med nekaj več kaj ali vse",
    "lt": "labas kaip sekasi šiandien man gerai labai ačiū koks tavo vardas mano vardas labas rytas labanakt iki rytojaus ar gali man padėti prašau norėčiau žinoti kur yra namas mes laukėme jų visą dieną ji pasakė kad jie neturėtų ten eiti nes buvo per vėlu ar nori ko nors valgyti taip ne galbūt aš tave labai myliu tai geriausias dalykas mūsų darbe žmonės mano kad niekas nepasikeis kai jūs parašysite atsakymą į mano klausimą taip pat visada dar tarp yra būti",
    "ru": "привет как дела сегодня у меня всё хорошо большое спасибо как тебя зовут меня зовут доброе утро спокойной ночи до завтра можешь мне помочь пожалуйста я хотел бы знать где находится дом мы ждали их весь день она сказала что им не следует туда идти потому что было слишком поздно хочешь что нибудь поесть да нет может быть я тебя очень люблю это самое лучшее в нашей работе люди думают что ничего не изменится когда вы напишете ответ на мой вопрос также всегда ещё если уже только был они эти чтобы",
    "uk": "привіт як справи сьогодні у мене все добре дуже дякую як тебе звати мене звати доброго ранку на добраніч до завтра можеш мені допомогти будь ласка я хотів би знати де знаходиться будинок ми чекали на них увесь день вона сказала що їм не слід туди йти тому що було надто пізно хочеш щось поїсти так ні можливо я тебе дуже кохаю це найкраще в нашій роботі люди думають що нічого не зміниться коли ви напишете відповідь на моє питання також завжди ще якщо вже тільки був вони ці щоб є її",
    "mk": "здраво како си денес добро сум многу благодарам како се викаш јас се викам добро утро добра ноќ се гледаме утре можеш ли да ми помогнеш те молам би сакал да знам каде е куќата ги чекавме цел ден таа рече дека не треба да одат таму затоа што беше премногу доцна сакаш ли да јадеш нешто да не можеби те сакам многу ова е најдоброто нешто во нашата работа луѓето мислат дека ништо нема да се промени кога ќе го напишете одговорот на моето прашање исто така секогаш уште ако веќе само биде тие",
    "el": "γεια σου πώς είσαι σήμερα είμαι καλά ευχαριστώ πολύ πώς σε λένε με λένε καλημέρα καληνύχτα τα λέμε αύριο μπορείς να με βοηθήσεις παρακαλώ θα ήθελα να ξέρω πού είναι το σπίτι τους περιμέναμε όλη την ημέρα είπε ότι δεν έπρεπε να πάνε εκεί γιατί ήταν πολύ αργά θέλεις να φας κάτι ναι όχι ίσως σε αγαπώ πολύ αυτό είναι το καλύτερο πράγμα στη δουλειά μας",
}
