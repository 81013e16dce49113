"""Held-out sentences for the abuse model, by language: (abusive, harmless).

Written before the model's word lists and training sentences, from everyday
situations that have nothing to do with the tables; never used to fit or tune it.
"""

HELD_OUT: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "en": (
        (
            "Honestly, you're the dumbest referee this league has ever had.", "I will put a bullet in your head.", "Somebody ought to slit that teacher's throat.", "I want to rape you.", "All Rohingya should be thrown in the sea.", "Black people are monkeys.", "Gays are a disease and should be locked up.", "Kill yourself, you worthless piece of trash.",
            "He is a lying scumbag and his wife is a whore.", "I hope your kids get cancer and die slowly.", "If you post that again I'll break every bone in your body.", "Shut up, you ugly cow, nobody wants to hear you.", "She sucked his cock in the back of the bus.", "Jews control everything, they are parasites.", "My manager is a complete moron.", "Send me a picture of your tits, babe.",
            "We know where your daughter goes to school.", "Women are too stupid to vote.", "You f*cking r3tard, uninstall the game.", "Immigrants are vermin.",
        ),
        (
            "What an idiot, I forgot my keys again.", "The vaccine kills the virus within hours.", "My grandmother died of cancer last spring.", "This stupid printer jams every morning.", "Women now make up half of the medical students.", "The museum shows naked figures from the Greek period.", "He shot three goals and beat the keeper each time.", "The forum bans users who write things like \"go kill yourself\".",
            "The bitch gave birth to five healthy puppies.", "The cock crows at dawn.", "We should crush the garlic before frying it.", "Muslims and Christians celebrated the harvest together.", "I am so stupid, I missed the train.", "The bullet train leaves at nine.", "Police arrested a man who had threatened to kill his neighbour.", "Sex education starts in the fifth year.",
            "Rats spread disease in the old harbour.", "You have a beautiful garden and a lovely dog.", "That movie was absolute trash.", "Refugees arrived by boat and were given food.",
        ),
    ),
    "es": (
        ("Eres la persona más estúpida que conozco.", "Te voy a cortar el cuello, hijo de puta.", "Los gitanos son ratas y hay que echarlos del país.", "Ojalá te mueras de cáncer.", "Chúpame la polla, zorra.", "Las mujeres solo sirven para fregar.", "Cállate, payaso de mierda.", "Sé dónde trabajas y te voy a encontrar."),
        ("Qué idiota soy, olvidé las llaves.", "El perro murió de viejo.", "Las mujeres ganaron la final por tres goles.", "Esta mierda de impresora no funciona.", "Corta el pollo en trozos pequeños.", "Los inmigrantes abrieron una panadería.", "Mi hermana trabaja en el hospital.", "Prohibimos insultos como «idiota» en el foro."),
    ),
    "de": (
        ("Du bist so dumm wie Brot.", "Ich stech dich ab, du Hurensohn.", "Alle Juden gehören ins Gas.", "Hoffentlich verreckst du bald.", "Deine Mutter ist eine Schlampe.", "Flüchtlinge sind Parasiten und Dreck.", "Halt dein Maul, du fette Sau.", "Ich will deine Titten sehen."),
        ("Ich Idiot habe den Schlüssel vergessen.", "Der Hund ist gestern gestorben.", "Frauen stellen die Hälfte der Studierenden.", "Der blöde Drucker klemmt schon wieder.", "Schneide die Zwiebeln klein.", "Die Flüchtlinge bekamen warme Suppe.", "Wir wissen, wo der Bus hält.", "Beleidigungen wie „Arschloch“ werden gelöscht."),
    ),
    "fr": (
        ("T'es vraiment le roi des cons.", "Je vais te crever, sale chien.", "Les Arabes sont des rats, qu'on les renvoie chez eux.", "J'espère que tu vas mourir seul.", "Suce ma bite, salope.", "Les femmes sont trop bêtes pour conduire.", "Ferme ta gueule, espèce de débile.", "On sait où tu habites, fais gaffe à toi."),
        ("Quel idiot je suis, j'ai raté le train.", "Mon grand-père est mort en mai.", "Les femmes ont gagné le match.", "Cette saleté d'imprimante est encore en panne.", "Coupez la tête du poisson.", "Les réfugiés ont reçu des couvertures.", "Elle habite près de la gare.", "Le règlement interdit les insultes comme « connard »."),
    ),
    "pt": (
        ("Você é um completo imbecil.", "Vou quebrar a tua cara, filho da puta.", "Os ciganos são uns porcos, fora daqui com eles.", "Tomara que você morra.", "Quero chupar os teus peitos.", "Mulher não serve para nada além de cozinhar.", "Cala a boca, sua vaca.", "Sei onde você mora, toma cuidado."),
        ("Que burro que eu sou, perdi o autocarro.", "O gato morreu ontem.", "As mulheres venceram a corrida.", "Esta porcaria de telemóvel não liga.", "Corte a carne em cubos.", "Os imigrantes abriram um restaurante.", "Ele mora perto da praia.", "O fórum proíbe palavras como «idiota»."),
    ),
    "it": (
        ("Sei proprio un idiota.", "Ti ammazzo, figlio di puttana.", "Gli zingari sono feccia, vanno cacciati tutti.", "Spero che tu muoia presto.", "Succhiami il cazzo, troia.", "Le donne sono troppo stupide per comandare.", "Chiudi quella bocca, stronzo.", "So dove abiti, ti vengo a prendere."),
        ("Che stupido sono, ho perso il treno.", "Il nonno è morto l'anno scorso.", "Le donne hanno vinto la partita.", "Questa maledetta stampante non funziona.", "Taglia la cipolla a pezzi.", "I migranti hanno aperto un negozio.", "Abito vicino alla stazione.", "Il regolamento vieta insulti come «stronzo»."),
    ),
    "nl": (
        ("Je bent een achterlijke idioot.", "Ik maak je dood, klootzak.", "Die Marokkanen zijn ongedierte.", "Ik hoop dat je sterft aan kanker.", "Laat je tieten zien, slet.", "Vrouwen zijn te dom om te rijden.", "Hou je bek, vieze hoer.", "Ik weet waar je woont, pas maar op."),
        ("Wat ben ik een sukkel, ik ben mijn sleutels vergeten.", "De hond is gisteren gestorven.", "De vrouwen wonnen de wedstrijd.", "Die stomme printer doet het weer niet.", "Snij de ui in stukken.", "De vluchtelingen kregen eten.", "Zij woont bij het station.", "Scheldwoorden zoals \"klootzak\" zijn verboden."),
    ),
    "pl": (
        ("Jesteś skończonym idiotą.", "Zabiję cię, skurwysynu.", "Żydzi to szczury.", "Mam nadzieję, że zdechniesz.", "Pokaż cycki, dziwko.", "Kobiety są za głupie, żeby głosować.", "Zamknij ryj, debilu.", "Wiem, gdzie mieszkasz, pożałujesz."),
        ("Ale ze mnie idiota, zapomniałem kluczy.", "Dziadek umarł w maju.", "Kobiety wygrały mecz.", "Ta głupia drukarka znowu nie działa.", "Pokrój cebulę w kostkę.", "Uchodźcy dostali ciepłą zupę.", "Mieszkam blisko dworca.", "Regulamin zabrania słów takich jak „debil”."),
    ),
    "ru": (
        ("Ты полный идиот.", "Я тебя убью, сука.", "Все евреи паразиты.", "Чтоб ты сдох.", "Покажи сиськи, шлюха.", "Бабы слишком тупые, чтобы водить машину.", "Закрой пасть, урод.", "Я знаю, где ты живёшь, ты пожалеешь."),
        ("Какой я идиот, забыл ключи.", "Собака умерла вчера.", "Женщины выиграли матч.", "Этот тупой принтер опять не работает.", "Порежьте лук кубиками.", "Беженцы получили горячий суп.", "Она живёт рядом с вокзалом.", "Правила запрещают слова вроде «дурак»."),
    ),
    "zh": (
        ("你真是个脑残。", "我要杀了你全家。", "黑人都是猴子。", "希望你早点死。", "给我看你的胸，骚货。", "女人都太蠢，不配投票。", "闭上你的臭嘴，贱人。", "我知道你住在哪里，你给我等着。"),
        ("我真是个笨蛋，又忘带钥匙了。", "狗昨天死了。", "女队赢得了比赛。", "这台破打印机又坏了。", "把洋葱切成小块。", "难民们领到了热汤。", "她住在车站附近。", "论坛规定禁止使用“白痴”这类词语。"),
    ),
}
