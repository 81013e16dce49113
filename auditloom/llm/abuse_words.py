"""Word lists and training sentences of the abuse model.

Everything here is general vocabulary and everyday speech: nothing is taken from any
table. Words are listed by language and concept; accents do not matter, a star at the
end stands for any ending. ``any`` holds in every language. Training sentences have
slots in braces that are filled from the lists.
"""

# Words by language and concept.
LEXICON: dict[str, dict[str, str]] = {
    "any": {
        "PROFANE": "fuck*|motherfuck*|wtf|stfu|gtfo",
        "INSULT": "asshole*|arsehole*|motherfucker*|dumbass*|dickhead*|fuckface*|fuckwit*|shithead*",
        "SLUR": "nigger*|nigga*|kike|kikes|faggot*|tranny|trannies|wetback*|chink|chinks|gook|gooks|paki|pakis|raghead*|towelhead*|spic|spics|beaner*|dyke|dykes|golliwog*",
        "SEXACT": "blowjob*|porn|porno|nudes|onlyfans|gangbang*|creampie|cumshot*",
    },
    "en": {
        "YOU": "you|your|yours|yourself|yourselves|you're|youre|ya|u|ur|thy|thou",
        "I": "i|i'm|i'll|i'd|i've|we|we're|we'll|us|me|somebody|someone|they|they'll",
        "PERSON": "he|she|him|his|her|guy|guys|man|men|woman|boy|girl|dude|bloke|colleague*|boss|manager|teacher|coach|referee|neighbour*|neighbor*|reviewer*|author*|editor|doctor|nurse|mayor|politician*|professor|expert*|driver|player*|moderator|clerk|landlord|whoever|anyone|anybody|everyone|nobody|people|person|student*|reader*|writer*|husband|wife|girlfriend|boyfriend|customer*|worker*",
        "FAMILY": "mother|mum|mom|father|dad|parents|sister|brother|daughter|son|kid|kids|children|family|wife|husband|grandmother|grandma|grandfather|dog|cat|baby",
        "GROUP": "women|woman|females|girls|men|migrant*|immigrant*|foreigner*|refugee*|asylum seekers|jew|jews|jewish|muslim*|christian*|catholic*|hindu*|black people|blacks|black folks|whites|white people|asians|africans|arab|arabs|mexicans|chinese|indians|poles|turks|russians|americans|gays|gay people|homosexual*|lesbians|queers|trans people|transgender*|disabled|cripples|old people|the elderly|pensioners|boomers|gypsies|gypsy|roma|rohingya|natives|outsiders|believers|atheists|tribe*|the poor|homeless|people like you|people like them|those people|these people|that lot|their kind|your kind|villagers|townsfolk|folk|folks|foreign|families|pickers|labourers|laborers|farm workers|seasonal workers|accent|settlers|peasants|foreign workers|newcomers|liberals|conservatives|blondes|feminists|wives",
        "ALL": "all|every|each|always|everything|whole|none|any|only",
        "INSULT": "idiot*|moron*|imbecile*|cretin*|halfwit*|half-wit*|dimwit*|nitwit*|dunce*|dumbo|dummy|numbskull*|numpty|dipshit*|muppet|blockhead*|bonehead*|simpleton*|loser*|scumbag*|lowlife*|low-life*|scum|bastard*|bitch|bitches|whore*|slut*|slag|cunt*|twat*|prick*|wanker*|tosser*|knobhead*|bellend*|git|pillock|plonker|jerk*|creep|pervert*|perv|coward*|liar*|cheat|fraud|clown*|buffoon*|fool|fools|pig|pigs|swine|weasel*|snake|snakes|rat|leech*|hag|crone|retard*|spastic*|psycho*|lunatic*|nutcase*|degenerate*|disgrace|waste of space|waste of oxygen|waste of skin|piece of shit|piece of crap|piece of trash|piece of garbage|piece of filth|sack of shit|shit for brains|son of a bitch|sonofabitch|ugly cow|fat cow|stupid cow|old cow|airhead*|brainless|douche*|douchebag*|jackass*|schmuck*|twit|crybaby|parasite|incompetent fool|fatso|fatty|lardass|skank*|tramp|harlot",
        "ADJ": "stupid*|dumb|dumber|dumbest|ugly|ugliest|filthy|disgusting|pathetic|worthless|useless|lazy|fat|greasy|brain-dead|braindead|clueless|spineless|gutless|two-faced|lying|stinking|smelly|rotten|vile|nasty|revolting|repulsive|miserable|idiotic|moronic|retarded|inbred|incompetent|mindless|gullible|greedy|slimy|sleazy|shitty|crappy|bloody|goddamn|damn|fucking|pathological|complete|total|utter|absolute|such a|such an|biggest|worst|thick|hopeless|vulgar|insane|deranged",
        "PROFANE": "shit*|bullshit|crap|damn|dammit|goddamn|bloody hell|piss|bollocks|bugger",
        "GOAWAY": "choke on your|go choke|go die|go drown|go hang|go to hell|burn in hell|rot in hell|get lost|fuck off|fuck you|fuck yourself|fuck your|piss off|sod off|bugger off|screw you|shut up|shut your|shut the fuck|eat shit|drop dead|bite me|up yours|suck it|kiss my ass|kiss my arse|get out of my sight|crawl back|nobody asked you|nobody wants you|nobody likes you|nobody cares what you|no one likes you|no one wants you",
        "KILL": "fumigat*|kill*|murder*|shoot|shot|stab*|strangle*|choke|hang|hanged|behead*|slit|slaughter*|butcher*|burn|burnt|burned|drown*|poison*|beat|bash*|smash*|break|crush*|punch*|slap*|kick*|rape*|cut|chop|gut|skin you|rip|tear|hurt|harm|hit|run over|knock out|blow up|bury|lynch*|execute*|gas|crucify|torture*|snap|twist|bullet|knife|acid|set fire|set on fire|finish you|end you|beat up|beat the|mess you up|castrat*|mutilat*",
        "BODY": "head|face|neck|throat|teeth|tooth|jaw|nose|skull|bones|bone|legs|leg|knees|kneecaps|arms|arm|fingers|hands|ribs|guts|brains out|spine|eyes|house|car|home",
        "DIE": "die|dies|dying|dead|death|suffer|perish|cancer|aids|hang yourself|kill yourself|kys|jump off|off a bridge|disappear|stop breathing|never been born|been aborted|aborted you|end your life|slit your wrists|choke on|get hit by|run over by|crash|rot|heart attack|stroke|drown|bleed|coffin|grave",
        "WISH": "hope|hopefully|wish|should|ought|deserve*|better off|better place|would be better|do us all|do the world|do everyone|favour|favor|pray|somebody should|someone should|must|need to|needs to|have to|can't wait|would cheer|would celebrate|would miss|would cry|would notice",
        "MENACE": "watch your back|watch your step|you will regret|you'll regret|you will pay|you'll pay|gonna pay|come after you|hunt you|get you for this|or else|next time you will|next time you won't|sleep with one eye|you're dead|you are dead|dead meat|your days are numbered|last warning|last thing you|not walk again|never walk again|be sorry|pay for this|teach you a lesson|won't see it coming",
        "IF": "next time i see you|next time you|if i see you|if i catch you|if i ever|if you ever|one more word|again and|once more|come near|show up|set foot|if you come",
        "UNLOVED": "would miss you|would shed a tear|shed a tear|would cry for you|would notice if you|would care if you|would mourn you|better without you|cleaner without you|better the day you|cleaner the day you|happier the day you|day you are gone|day you die|wish you were never|should never have been born|parents should have|mother should have|mum should have|mom should have|waste of food|wasted food|add nothing|nobody would weep",
        "ONLY": "nothing but|nothing more than",
        "DEHUMAN": "vermin|scum|filth|parasite*|cockroach*|roaches|rats|animals|apes|monkeys|savages|subhuman*|untermensch*|disease|cancer|plague|trash|garbage|leeches|dogs|pigs|lice|maggots|locusts|barbarians|thieves|criminals|rapists|terrorists|whores|sluts|inferior|second-class|infest*|overrun*|stink|smell",
        "EXPEL": "deport*|expel*|exterminat*|eradicat*|eliminat*|wipe out|wiped out|wipe them|get rid of|throw out|thrown out|throw them|thrown in|thrown into|kick out|kicked out|kick them|drive out|driven out|round up|rounded up|send back|sent back|send them|ship back|shipped back|ship them|go back to|back where they came|back to where|lock up|locked up|lock them|put down|sterili*|ban them|keep them out|gassed|gas them|burn them|shoot them|hang them|kill them|drown them|kicked off|chased out|removed from",
        "SEXBODY": "tits|titties|boobs|boobies|ass|arse|cock|cocks|dick|dicks|penis|pussy|pussies|cunt|clit|nipples|thighs|crotch|balls|butt|breasts|cleavage|panties|knickers|vagina|erection|boner|hard-on",
        "SEXACT": "fuck her|fuck him|fuck me|fucked her|fucked him|fucked me|suck my|suck me|sucked|lick my|lick your|lick her|lick him|licked|ride me|rode him|horny|masturbat*|jerk off|jerked off|orgasm*|moan*|cum|cumming|came inside|inside her|inside me|naked|nude|undress*|out of those clothes|out of that dress|out of her clothes|out of his clothes|out of your clothes|get her out of|get you out of|get him out of|out of those|strip for|take off your clothes|take your clothes off|spread your legs|spread her legs|bend over|bent over|on your knees|go down on|have sex|had sex|sex with|sleep with you|make love|made love|thrust*|anal|oral sex|threesome|dirty pictures|sexy pictures|sexual favours|sexual favors|turn me on|turns me on|so wet|so hard for|get me hard|hot body|screw her|screw him|bang her|banged her|shag*|grope*|touch myself|touching myself|kiss every inch|want you naked|in my bed|between your legs|between her legs",
        "PEST": "aphid*|beetle*|moth|moths|weevil*|mite|mites|larva*|larvae|caterpillar*|insect*|bug|bugs|pest|pests|fly|flies|mosquito*|ant|ants|wasp*|locust|slug*|snail*|weed|weeds|fungus|fungi|mould|mold|virus*|bacteria|germ|germs|cell|cells|mouse|mice|tick|ticks|flea|fleas|colony|colonies|nest|spray|trap|traps|seedling*|crop|crops|leaf|leaves|plant|plants|frost|pesticide*|insecticide*|herbicide*|vaccine*|antibiotic*|specimen*|nymph*|thrips|grass|clover|thistle*|nettle*|toadflax|daisy|flax|wheat|barley|oats|maize|oak|pine|fern|moss|grub|grubs|borer*|scale insects",
        "BIO": "species|mating|copulat*|pheromone*|reproduc*|genital*|ovipositor*|dimorphism|females|males|female|male|breeding|embryo|egg|eggs|chromosome*|hormone*|anatomy|patient*|screening|clinic|hospital|surgeon|surgery|diagnos*|symptom*|biology|gene|genes|puppies|litter|gave birth|mammal*|bird|birds|poultry|tit|donkey|rooster|hen|hens|sperm|pollen|intercourse|penetrat*|organ|organs|body fat|breast cancer|breastfeeding|naked eye",
        "POLICY": "policy|policies|rules|rule|guideline*|forbid*|forbidden|prohibit*|ban|bans|banned|bannable|moderat*|removed|deleted|reported|report|reports|flagged|hate speech|harassment|code of conduct|not allowed|not tolerated|complaint|training|dictionary|definition|the word|words like|phrases like|terms like|insults like|called|example of|quote|quoted|novel|film|movie|play|song|chapter|character|history|historian*|museum|court|trial|judge|police|arrested|sentenced|lawsuit|victim*|survivor*|campaign against|study|survey|article|lesson|seminar|workshop",
        "THING": "weather|rain|wind|heat|mud|printer*|computer|laptop|phone|software|code|bug|game|level|battery|camera|cable|sprayer|pump|hose|tractor|engine|machine|tool|tools|traffic|train|bus|flight|shoes|boots|keyboard|screen|wifi|internet|app|website|form|paperwork|alarm|clock|homework|exam|test|recipe|coffee|soup|door|lock|key|keys|fence|ladder|screw|bolt|road|idea|mistake|question|excuse|error|file|files|process|thread|server|deadline|budget|plan|song|movie|match|season|penalty|goal|goals|record|price|nail|lamp",
        "COOK": "onion*|garlic|fry|frying|oven|meat|chicken|fish|potato*|carrot*|dough|flour|butter|sauce|salad|slices|cubes|pieces|bake|boil|grill|bread|cheese|lemon|tomato*|apple*|cream|sugar|batter|pan|dish|cook*",
        "SELF": "i am such|i'm such|i am so|i'm so|i was such|i was so|i was a|i was an|i feel like|myself|my own|my mistake|my fault|i forgot|i missed|i lost|i broke|i left|me, i|stupid me|silly me|i felt",
        "KIND": "thank*|please|sorry|congratulation*|well done|great job|good work|love the|lovely|beautiful|wonderful|kind|brave|proud|welcome|invited|helped|celebrat*|harvested|won|win|winning|elected|scored|joined|opened|founded|wrote|studied|graduated|married|cooperat*|volunteer*|donat*|saved",
        "NEG": "not|never|no|isn't|aren't|wasn't|don't|doesn't|nobody|nothing|without|stop calling|do not call|don't call",
        "COMPARE": "let you out of|more brains than|more sense than|more use than|smarter than|brighter than|prettier than|more intelligent than|has more iq|iq of a|brain of a|brains of a|as dumb as|as stupid as|dumb as|thick as|uglier than|face like a|smell like a|smells like a|look like a pig|look at you|looking at you|your face|your mother|your mum|your mom|were you dropped|dropped on your head|did your parents|learn to read|can't even|couldn't even|too dumb|too stupid|waste of",
        "SCORN": "too dirty to|too slow to|too thick to|no better than|same kind of|as bad as the|since they let|ever since they came|let them in|went downhill|spread like|steal whatever|bred like|do not have the brains|have no brains|not smart enough|not clever enough|not have the brain|not fit to|have no shame|would not let|wouldn't let|never let|breed like|multiply like|too stupid to|too dumb to|too lazy to|not human|less than human|do not belong|don't belong|doesn't belong|belong in|belong behind|belong back|have no place|good for nothing|only good for|ruin everything|ruin our|steal our|steal everything|take our jobs|taking over|live off|born liars|born thieves|can't be trusted|cannot be trusted|never trust|control everything|control the|run the world|not real",
        "LURK": "know where you|know where your|we know where|i know where|come for you|coming for you|will find you|find out where|know your address|know your route|know your schedule|know what you drive|know which|waiting for you|wait for you outside|outside your house|accidents happen|something might happen",
    },
    "es": {
        "YOU": "tú|tu|te|ti|tus|tuyo|eres|usted|ustedes|vosotros|os|contigo|vos|sos|vete|cállate|calla|mírate|muérete",
        "I": "yo|me|mi|mis|nos|voy a|vamos a|quiero|queremos",
        "PERSON": "él|ella|ese tipo|esa tipa|hombre|mujer|jefe|jefa|profesor*|vecino*|árbitro|revisor*|alcalde|médico|autor*|quien|quienquiera|tipo|tipa|señor*",
        "FAMILY": "madre|padre|hijo|hija|hermana|hermano|abuelo|abuela|perro|gato|familia|esposa",
        "GROUP": "mujeres|hombres|gitanos|judíos|moros|musulmanes|negros|indios|inmigrantes|migrantes|extranjer*|refugiados|gays|maricones|homosexuales|viejos|ancianos|pobres|sudacas|chinos|árabes|africanos|esa gente|esos|esas|creyentes",
        "ALL": "todos|todas|todo|cada|siempre|solo",
        "INSULT": "idiota*|imbécil*|estúpid*|tont*|gilipollas|cabrón*|cabrona*|capullo*|payaso*|inútil*|pendej*|boludo*|pelotudo*|subnormal*|retrasad*|mongol*|hijo de puta|hija de puta|hijos de puta|hijoputa|puta|putas|zorra*|perra|guarra|cerd*|burro|asno|basura humana|escoria|mierda seca|desgraciad*|malnacid*|bastard*|canalla*|cobarde*|mentiros*|fracasad*|maldit*|sinvergüenza*|cretin*|bobo|baboso|pedazo de mierda|pedazo de|maricón|nadie te quiere|loca",
        "ADJ": "estúpid*|asqueros*|sucio*|sucia*|gord*|feo|fea|feos|inútil*|miserable*|patético*|repugnante*|vago*|vaga*|apestos*|imbécil*|completo|completa|más tonto|maldit*|podrid*|puto|puta|de mierda",
        "PROFANE": "mierda*|joder|coño|hostia|carajo|puta madre",
        "GOAWAY": "vete a la mierda|vete al infierno|que te den|que te jodan|jódete|cállate|cierra la boca|cierra el pico|púdrete|lárgate|vete al carajo|vete a tomar|no vales nada|no sirves para nada|nadie te quiere|me cago en|chinga tu",
        "KILL": "mat*|matarte|asesin*|apuñal*|dispar*|degoll*|estrangul*|quem*|rompe*|romper*|romperte|parti*|partirte|cort*|cortarte|golpe*|viol*|ahorc*|aplast*|reventar*|revient*|machac*|te parto|te reviento|apaliz*|pegar*|rajar*|rajo|rompo",
        "BODY": "cuello|cara|cabeza|piernas|pierna|dientes|huesos|brazos|dedos|garganta|nariz|boca",
        "DIE": "mueras|muera|mueran|morir|muerto|muerta|muérete|muerte|cáncer|suicíd*|mátate|desaparezc*|te pudras|reventar|murió|muera",
        "WISH": "ojalá|espero que|deberías|debería*|deberían|habría que|hay que|merec*|mejor si|nadie llor*",
        "MENACE": "te voy a encontrar|te encontrar*|te vas a arrepentir|te arrepentir*|lo vas a pagar|lo pagar*|cuídate la espalda|vas a ver|voy a por ti|acabaré contigo|acabo contigo",
        "IF": "como vuelvas|si vuelves|si te veo|si vuelvo a verte|otra vez",
        "UNLOVED": "nadie lloraría|nadie te llorar*|nadie te echar*|no deberías haber nacido|ojalá no hubieras nacido|estaríamos mejor sin ti",
        "ONLY": "no eres más que|no es más que|no son más que",
        "DEHUMAN": "ratas|basura|escoria|plaga|parásit*|animales|monos|simios|cucarachas|alimañas|salvajes|perros|cerdos|enfermedad|cáncer|ladrones|criminales|inferiores|infrahuman*|apestan",
        "EXPEL": "echarlos|echarlas|echar a|echar a todos|expuls*|deport*|extermin*|elimin*|fuera de aquí|fuera del país|que se vayan|que se larguen|que vuelvan|encerrar*|acabar con ellos|matarlos|quemarlos|al paredón",
        "SEXBODY": "polla*|tetas|culo|coño|chocho|verga|pene|pezones|pechos|muslos|huevos|bragas",
        "SEXACT": "chup*|lam*|foll*|coger*|correrme|correrte|me corro|cachond*|calient*|desnud*|masturb*|mamada|orgasmo*|gemí*|gimi*|sexo contigo|acostarme contigo|métemela|te la meto|en mi cama|en pelotas",
        "PEST": "plagas|insecto*|pulgón*|larva*|oruga*|mosca*|mosquito*|virus|bacteria*|hongo*|planta*|hoja*|cultivo*|trampa*|araña*|hormiga*|semilla*|vacuna*|polilla*|escarabajo*|helada",
        "BIO": "hembra*|macho*|apareamiento|feromon*|reproducci*|especie*|hospital|médic*|paciente*|cirug*|tumor|mama|aves|gallina*",
        "POLICY": "normas|reglas|prohib*|reglamento|insultos como|palabras como|foro|moderador*|denuncia*|policía|juez|juicio|condenad*|novela|película|historia|museo|artículo|detuv*",
        "THING": "impresora|ordenador|coche|móvil|lluvia|tiempo|tren|autobús|llaves|puerta|cámara|lente|máquina|tractor|partido|idea|error|examen|internet|cable|batería",
        "COOK": "cebolla*|ajo|pollo|carne|pescado|patata*|tomate*|trozos|rodajas|horno|sartén|receta|pan|queso",
        "SELF": "soy|qué idiota soy|qué tonto soy|soy tan|olvidé|me olvidé|perdí|yo mismo|mi culpa|mi error",
        "KIND": "gracias|por favor|perdón|felicidades|ganaron|ganó|abrieron|ayud*|celebr*|bienvenid*|hermos*|enhorabuena|invit*",
        "NEG": "no|nunca|ni|jamás|sin",
        "COMPARE": "más cerebro que|más listo que|más tonto que|cerebro de mosquito|cara de|tu madre|pareces un|das asco|me das asco|nadie te soporta|no vales|más estúpida que|más feo que",
        "SCORN": "no son personas|solo sirven|no sirven|nos roban|nos invaden|demasiado tont*|no saben más que",
        "LURK": "sé dónde|sabemos dónde|ten cuidado|te espero|te estamos esperando",
    },
    "de": {
        "YOU": "du|dich|dir|dein*|ihr|euch|euer|eure*|deinen|bist",
        "I": "ich|wir|mich|mir|uns|man",
        "PERSON": "er|sie|ihn|der typ|typ|kerl|mann|frau|chef|lehrer*|nachbar*|kolleg*|trainer|schiedsrichter*|gutachter*|autor*|wer|jeder|dieser",
        "FAMILY": "mutter|vater|sohn|tochter|bruder|schwester|oma|opa|hund|katze|familie|kinder|frau",
        "GROUP": "frauen|weiber|männer|juden|muslime|moslems|türken|polen|zigeuner|neger|schwarze|schwarzen|ausländer*|flüchtlinge*|migranten|asylanten|homosexuelle*|schwule*|schwuchteln|lesben|behinderte*|alte leute|rentner|araber|afrikaner|fremde|fremden|einwanderer|kanaken|gläubige*|leute wie die|solche leute|diese leute|christen",
        "ALL": "alle|alles|jeder|immer|ganze|nur",
        "INSULT": "idiot*|trottel*|depp*|dummkopf*|vollidiot*|vollpfosten|schwachkopf*|arschloch*|arschlöcher|wichser*|hurensohn*|hurensöhne|hure|huren|schlampe*|fotze*|miststück*|drecksau|drecksack|sau|schwein*|versager*|loser|penner|abschaum|missgeburt*|spast*|mongo|behindert*|blödmann|blöde kuh|dumme kuh|kuh|esel|hornochse|pfeife|flasche|feigling*|lügner*|betrüger|widerling|ekel|nichtsnutz*|heuchler|lappen|opfer|bastard*|lump*|dreckskerl*|mistkerl*|dumm wie",
        "ADJ": "dumm*|blöd*|dämlich*|hässlich*|widerlich*|ekelhaft*|fett|fette*|fetten|faul*|dreckig*|stinkend*|erbärmlich*|nutzlos*|wertlos*|jämmerlich*|verlogen*|feige|hirnlos*|verdammte*|verfickte*|beschissen*|größte|so ein|so dumm|völlig",
        "PROFANE": "scheiß*|scheiss*|scheisse|scheiße|verdammt*|mist|kacke|fick*",
        "GOAWAY": "verpiss dich|halt die fresse|halt die klappe|halt dein maul|halt's maul|maul halten|fick dich|leck mich|fahr zur hölle|hau ab|zieh leine|geh sterben|niemand mag dich|keiner mag dich|keiner will dich|scher dich|du kannst mich mal|friss scheiße",
        "KILL": "töte*|umbring*|bring dich um|ermord*|erschieß*|erschiess*|erstech*|stech*|absteche|stech dich ab|erwürg*|erhäng*|verbrenn*|schlag dir|schlag dich|schlage dir|schlage dich|schlagen dich|schlag ihm|erschlag*|verprügel*|prügel*|zerschlag*|brech*|breche|schneid*|vergewaltig*|abknall*|knall dich|zerquetsch*|tret*|kopf ab|vergas*|köpfen",
        "BODY": "kopf|hals|genick|knochen|beine|bein|zähne|nase|finger|gesicht|schädel|arme|kehle|kiefer",
        "DIE": "sterb*|stirb|stirbst|verreck*|krepier*|tod|tot|krebs|verrott*|abkratz*|abnippel*|erstick*|verschwinde*|bring dich|gestorben",
        "WISH": "hoffentlich|ich hoffe|hoffe|wünsch*|sollte*|sollten|gehört|gehören|verdien*|besser dran|wäre besser|niemand würde|keiner würde|müsste*|muss man",
        "MENACE": "wirst es bereuen|wirst du bereuen|wirst bezahlen|krieg dich|kriege dich|mach dich fertig|mache dich fertig|mach dich kalt|letzte warnung|dreh dich um",
        "IF": "komm noch einmal|noch einmal|wenn ich dich|wenn du noch|wenn du wieder",
        "UNLOVED": "keiner würde weinen|niemand würde weinen|niemand würde dich vermissen|keiner würde dich vermissen|ohne dich besser|hätte dich|nie geboren",
        "ONLY": "nur ein|nichts als|bloß ein",
        "DEHUMAN": "abschaum|ungeziefer|parasiten|ratten|dreck|pest|seuche|affen|tiere|viecher|untermensch*|kakerlaken|gesindel|pack|gesocks|schmarotzer*|krankheit|müll|schweine|wilde|verbrecher|diebe|minderwertig*|stinken",
        "EXPEL": "raus mit|raus hier|ausrott*|abschieb*|vertreib*|verjag*|gejagt|rauswerf*|rausgeworfen|ins gas|vergasen|einsperr*|wegsperr*|ausweis*|an die wand|zurück nach|verschwinden|aus dem land|vernicht*",
        "SEXBODY": "titten|brüste|arsch|schwanz|schwänze|muschi|möse|penis|nippel|schenkel|eier",
        "SEXACT": "ficken|gefickt|fick mich|blasen|blas mir|lecken|leck meine|nackt*|geil*|wichsen|vögeln|gevögelt|stöhn*|orgasm*|sex mit|ausziehen|zieh dich aus|bumsen|nacktbilder|in meinem bett|mach mich heiß|feucht für",
        "PEST": "schädling*|insekt*|blattl*|larve*|larven|raupe*|käfer*|milbe*|fliege*|mücke*|pilz*|virus|viren|bakterien|unkraut|pflanze*|blatt|blätter|falle|fallen|ernte|schnecke*|ameise*|impfung|frost|motte*",
        "BIO": "weibchen|männchen|paarung*|pheromon*|fortpflanzung|art|arten|krankenhaus|patient*|klinik|tumor|henne|hahn|vogel|vögel|meise*|gewebe",
        "POLICY": "regel*|hausordnung|verbot*|verboten|gelöscht|gesperrt|beleidigungen wie|wörter wie|worte wie|polizei|gericht|urteil|verhaftet|roman|film|geschichte|museum|artikel|moderator*|gemeldet|studie",
        "THING": "drucker|rechner|computer|handy|auto|regen|wetter|zug|bus|schlüssel|tür|kamera|maschine|traktor|spiel|idee|fehler|prüfung|akku|kabel",
        "COOK": "zwiebel*|knoblauch|fleisch|huhn|fisch|kartoffel*|tomate*|würfel|scheiben|ofen|pfanne|rezept|brot|käse|klein",
        "SELF": "ich idiot|ich trottel|ich depp|ich dummkopf|bin ich|ich bin|ich war|vergessen|verloren|mein fehler|meine schuld|mein eigener",
        "KIND": "danke*|bitte|entschuldig*|glückwunsch|gewann*|gewonnen|geholfen|willkommen|schön*|eingeladen|bekamen|gefeiert|hilfe",
        "NEG": "nicht|kein*|nie|niemals|ohne|keiner",
        "COMPARE": "mehr hirn als|mehr verstand als|klüger als|schlauer als|dümmer als|dumm wie|hässlich wie|deine mutter|deine fresse|dein gesicht|zu blöd|zu dumm|siehst aus wie|stinkst wie|hat man dich",
        "SCORN": "vermehren sich|zu dumm zum|zu dumm um|zu faul|nehmen uns|haben hier nichts",
        "LURK": "weiß wo|weiss wo|wissen wo|pass auf|pass bloß auf|finde dich|finden dich|warten auf dich|warte auf dich",
    },
    "fr": {
        "YOU": "tu|te|toi|ton|ta|tes|t'es|vous|votre|vos|es|t'as",
        "I": "je|j'ai|moi|me|nous|on|j'espère|je vais|j'vais",
        "PERSON": "il|elle|lui|ce type|ce mec|cette fille|homme|femme|patron*|professeur*|prof|voisin*|arbitre|collègue*|relecteur*|auteur*|médecin|maire|celui|quiconque|mec|nana",
        "FAMILY": "mère|père|fils|fille|soeur|frère|grand-père|grand-mère|chien|chat|famille|enfants",
        "GROUP": "femmes|hommes|arabes|juifs|musulmans|noirs|nègres|gitans|roms|étranger*|immigrés|migrants|réfugiés|homos|homosexuels|gays|pédés|lesbiennes|handicapés|vieux|chinois|africains|ces gens|cette race|bonnes femmes|croyants|bougnoules|pauvres",
        "ALL": "tous|toutes|tout|chaque|toujours|seul*",
        "INSULT": "idiot*|imbécile*|connard*|connasse*|gros con|sale con|pauvre con|espèce de con|petit con|un con|quel con|le con|des cons|conne|les cons|abruti*|débile*|crétin*|salaud*|salope*|pute|putes|putain de|enculé*|enfoiré*|bâtard*|fils de pute|ordure*|raclure*|merdeux|minable*|bouffon*|clown|tocard*|pauvre type|sale type|sale chien|porc|cochon*|truie|grosse vache|vache|ânes|menteur*|lâche*|raté*|taré*|mongol*|attardé*|tapette|pourriture*|sous-merde|espèce de|roi des|poufiasse*|garce*|trou du cul",
        "ADJ": "stupide*|bête|bêtes|nul|nulle|nuls|laid*|moche*|gros|grosse|sale|sales|dégoûtant*|répugnant*|pathétique*|inutile*|paresseu*|feignant*|puant*|minable*|débile*|vraiment|complètement|foutu*|maudit*",
        "PROFANE": "merde*|putain|bordel|foutre|chier|saleté",
        "GOAWAY": "va te faire|ferme ta gueule|ta gueule|ferme-la|ferme la|la ferme|va au diable|va crever|dégage d'ici|dégagez|casse-toi|tire-toi|va mourir|nique ta|nique|va chier|personne ne t'aime|tu ne vaux rien|tu ne sers à rien|je t'emmerde",
        "KILL": "tuer|tue|tuerai|buter|bute|crever|creve|assassin*|poignard*|étrangl*|égorg*|brûler|brûle|casser|casse|briser|brise|frapp*|cogn*|tabass*|viol*|pendre|noyer|écras*|défonc*|démoli*|éclat*|massacr*|décapit*|planter un|coupe|couper|coupez|arrach*|cramer|gaz*|balle dans|exploser",
        "BODY": "tête|gueule|cou|gorge|jambes|jambe|dents|os|bras|doigts|nez|crâne|visage|mâchoire",
        "DIE": "mourir|meurs|meure|meures|mort|morte|crève|crèves|crever|cancer|suicide*|pends-toi|pourrir|disparai*|étouff*",
        "WISH": "j'espère|espère|devrait|devraient|devrais|mérite*|il faut|faut|faudrait|mieux sans|qu'on|vivement|personne ne pleur*|personne ne te",
        "MENACE": "tu vas le regretter|tu le regretter*|tu vas payer|tu me le paieras|gare à toi|on va te|je vais te|dernier avertissement|tu vas voir",
        "IF": "si tu reviens|si je te revois|reviens|remets les pieds|encore une fois",
        "UNLOVED": "personne ne te pleur*|personne ne pleur*|tu ne manqueras à personne|mieux sans toi|jamais dû naître",
        "ONLY": "n'es qu'un|n'es qu'une|n'est qu'un|n'est qu'une|ne sont que",
        "DEHUMAN": "rats|ordures|vermine|parasites|cafards|animaux|singes|chiens|porcs|racaille|sauvages|sous-hommes|maladie|peste|cancer|déchets|voleurs|criminels|inférieur*|nuisibles|puent",
        "EXPEL": "renvoie*|renvoy*|chasser|virer|virez|expuls*|extermin*|élimin*|éradiqu*|dehors|foutre dehors|jeter|rentrer chez eux|chez eux|enferm*|à la mer|déport*|au four|les pendre|les tuer",
        "SEXBODY": "bite*|nichons|seins|cul|chatte|couilles|queue|pénis|tétons|cuisses|fesses",
        "SEXACT": "suce*|sucer|lèche*|lécher|baise*|baiser|baisée|bander|bande pour|branle*|jouir|jouis|nue|nues|nu devant|à poil|déshabill*|gémi*|orgasme*|coucher avec|dans mon lit|excit*|écarte les jambes|désir de toi|niquer",
        "PEST": "insecte*|puceron*|larve*|chenille*|mouche*|moustique*|ravageur*|virus|bactérie*|champignon*|plante*|feuille*|piège*|récolte*|limace*|fourmi*|vaccin*|gel",
        "BIO": "femelle*|mâle*|accouplement*|phéromone*|espèce|espèces|reproduction|hôpital|patient*|médecin*|tumeur|poule*|oiseau*|mésange*",
        "POLICY": "règlement|règle*|interdit*|interdire|insultes comme|mots comme|forum|modérat*|signal*|police|tribunal|procès|condamn*|roman|film|histoire|musée|article|mis en examen",
        "THING": "imprimante|ordinateur|téléphone|voiture|pluie|temps|train|bus|clés|porte|appareil|machine|tracteur|match|idée|erreur|examen|batterie|câble",
        "COOK": "oignon*|ail|viande|poulet|poisson|pomme*|tomate*|morceaux|rondelles|four|poêle|recette|pain|fromage",
        "SELF": "je suis|quel idiot je|j'ai oublié|j'ai raté|j'ai perdu|ma faute|mon erreur|moi-même",
        "KIND": "merci|s'il vous plaît|s'il te plaît|pardon|félicitations|bravo|gagné*|reçu|ouvert|aidé*|bienvenue|beau|belle|invité*|fêt*",
        "NEG": "ne|pas|jamais|sans|aucun*|personne",
        "COMPARE": "plus intelligent que|plus de cervelle|plus bête que|bête comme|con comme|moche comme|ta mère|ta gueule|ta tête|tu ressembles|tu pues|trop bête|trop con",
        "SCORN": "trop bêtes|trop stupides|nous envahissent|nous volent|se reproduisent comme|ne servent",
        "LURK": "sait où tu|sais où tu|sais où|fais gaffe|méfie-toi|on t'attend|je te retrouv*|on te retrouv*",
    },
    "pt": {
        "YOU": "tu|te|ti|teu|teus|tua|tuas|você|vocês|vc|seu|sua|contigo|és",
        "I": "eu|me|meu|minha|nós|nos|vou|vamos|quero",
        "PERSON": "ele|ela|aquele tipo|aquele cara|cara|homem|mulher|chefe|professor*|vizinho*|árbitro|revisor*|autor*|médico|prefeito|quem|tipo|gajo",
        "FAMILY": "mãe|pai|filho|filha|irmã|irmão|avô|avó|cão|cachorro|gato|família",
        "GROUP": "mulheres|mulher|homens|ciganos|judeus|muçulmanos|negros|pretos|imigrantes|migrantes|estrangeir*|refugiados|gays|homossexuais|bichas|velhos|idosos|pobres|chineses|árabes|africanos|índios|nordestinos|essa gente|esses|essas|crentes",
        "ALL": "todos|todas|tudo|cada|sempre|só",
        "INSULT": "idiota*|imbecil*|estúpid*|burr*|otári*|cretin*|palhaç*|cabrão*|cabrões|canalha*|babaca*|escroto*|arrombad*|desgraçad*|filho da puta|filha da puta|filhos da puta|puta|putas|vadia*|vaca|cadela|piranha|porco|porca|porcos|lixo humano|merdas|bosta|inútil*|palerma*|parvo*|parva*|retardad*|débil mental|corno|viado|bicha|covarde*|mentiros*|fracassad*|nojento*|safad*|trouxa*",
        "ADJ": "estúpid*|burr*|nojent*|sujo*|suja*|gord*|feio|feia|feios|inútil|inúteis|preguiços*|fedorent*|ridícul*|patétic*|completo|completa|maldit*|pobre de|de merda",
        "PROFANE": "merda*|porra|caralho|foda|foda-se|foder|porcaria|droga",
        "GOAWAY": "vai à merda|vai a merda|vai-te foder|vai se foder|vai tomar no|cala a boca|cala-te|cala essa boca|vai para o inferno|vai pro inferno|vai morrer|some daqui|desaparece|ninguém gosta de ti|ninguém gosta de você|não vales nada|não serves para nada|vai à puta",
        "KILL": "matar|mato|mata-te|matar-te|matá-lo|assassin*|esfaque*|atirar|dar um tiro|estrangul*|queim*|quebrar|quebro|partir|parto|parto-te|bater|bato|espanc*|esmag*|violar|estupr*|enforc*|afog*|cortar|corte|rebent*|arrebent*|degol*|acabo contigo",
        "BODY": "cara|cabeça|pescoço|pernas|perna|dentes|ossos|braços|dedos|garganta|nariz|boca",
        "DIE": "morra|morras|morrer|morre|morto|morta|morte|morreu|câncer|cancro|suicid*|mata-te|se mate|apodreç*|desapareç*|sufoc*",
        "WISH": "tomara|oxalá|espero que|devia|deviam|devias|deveria*|merec*|tem que|têm que|ninguém choraria|ninguém vai chorar|melhor sem",
        "MENACE": "vais arrepender|vai se arrepender|arrepend*|vais pagar|vai pagar|vou te pegar|vou te achar|vou-te apanhar|último aviso|vais ver",
        "IF": "se voltares|se você voltar|se te vejo|mais uma vez",
        "UNLOVED": "ninguém choraria|ninguém vai chorar|ninguém sentiria|melhor sem ti|melhor sem você|nunca devias ter nascido",
        "ONLY": "não passas de|não passa de|não és mais que|não é mais que",
        "DEHUMAN": "ratos|lixo|escória|praga|parasitas|animais|macacos|baratas|porcos|cães|selvagens|vermes|doença|ladrões|bandidos|criminosos|inferiores|fedem|roubam|invadem|escumalha",
        "EXPEL": "expuls*|deport*|extermin*|elimin*|fora daqui|fora com|mandar embora|manda embora|rua com|voltem para|de volta para|prender todos|queimar todos|correr com eles",
        "SEXBODY": "pau|caralho|mamas|peitos|peitinhos|bunda|cu|cona|buceta|xoxota|pila|pênis|mamilos|coxas|tetas",
        "SEXACT": "chup*|lamb*|foder|fodi|fodeu|comer-te|te comer|tesão|nua|nuas|nu|pelad*|masturb*|gem*|orgasmo*|gozar|gozei|transar|sexo contigo|sexo com você|na minha cama|boquete|excitad*",
        "PEST": "praga de|pragas|inseto*|pulgão|pulgões|larva*|lagarta*|mosca*|mosquito*|vírus|bactéria*|fungo*|planta*|folha*|armadilha*|colheita|lesma*|formiga*|vacina*|geada|traça*",
        "BIO": "fêmea*|macho*|acasalamento|feromon*|espécie*|reproduç*|hospital|paciente*|tumor|galinha*|ave|aves",
        "POLICY": "regras|regulamento|proíb*|proibid*|insultos como|palavras como|fórum|moderador*|denúncia*|polícia|tribunal|julgamento|condenad*|romance|filme|história|museu|artigo|preso",
        "THING": "impressora|computador|telemóvel|celular|carro|chuva|tempo|comboio|trem|autocarro|ônibus|chaves|porta|câmara|câmera|lente|máquina|trator|jogo|ideia|erro|exame|bateria|cabo",
        "COOK": "cebola*|alho|carne|frango|peixe|batata*|tomate*|cubos|pedaços|forno|panela|receita|pão|queijo",
        "SELF": "que burro que eu|sou|eu sou|esqueci|perdi|minha culpa|meu erro|mim mesmo|que idiota eu",
        "KIND": "obrigad*|por favor|desculp*|parabéns|venceram|ganh*|abriram|ajud*|bem-vind*|linda|lindo|convid*|celebr*|receberam",
        "NEG": "não|nunca|nem|sem|ninguém",
        "COMPARE": "mais cérebro que|mais cérebro do que|mais esperto que|mais burro que|cara de|tua mãe|a sua mãe|pareces um|parece um|metes nojo|muito burro|burro como|feio como",
        "SCORN": "não são gente|não serve para|não servem|só servem|demasiado burr*|muito burr*",
        "LURK": "sei onde|sabemos onde|toma cuidado|cuidado contigo|estamos à espera|te espero",
    },
    "it": {
        "YOU": "tu|te|ti|tuo|tua|tuoi|tue|sei|voi|vi|vostro|vostra|siete",
        "I": "io|mi|noi|ci|mio|voglio|vogliamo",
        "PERSON": "lui|lei|quel tipo|quello|quella|uomo|donna|capo|professor*|vicin*|arbitro|collega|autor*|medico|sindaco|chi|chiunque|tizio",
        "FAMILY": "madre|padre|figlio|figlia|sorella|fratello|nonno|nonna|cane|gatto|famiglia|figli",
        "GROUP": "donne|uomini|zingari|ebrei|musulmani|neri|negri|immigrati|migranti|stranier*|profughi|rifugiati|gay|omosessuali|froci|vecchi|anziani|cinesi|arabi|africani|terroni|rom|quella gente|questa gente|credenti",
        "ALL": "tutti|tutte|tutto|ogni|sempre|solo",
        "INSULT": "idiot*|imbecill*|stupid*|cretin*|deficient*|coglion*|stronz*|bastard*|figlio di puttana|figli di puttana|puttan*|troi*|zoccol*|merdos*|pezzo di merda|buffon*|pagliacc*|incapac*|fallit*|ritardat*|mongoloid*|maial*|porc*|vacca|asino|somar*|schifos*|vigliacc*|bugiard*|carogna|feccia|sfigat*|scem*|ignorant*|testa di cazzo|faccia di merda|frocio",
        "ADJ": "stupid*|brutt*|schifos*|grass*|inutil*|patetic*|sporc*|puzzolent*|pigr*|ridicol*|maledett*|proprio|completo|fottut*|disgustos*|scem*",
        "PROFANE": "merda*|cazzo|porca|vaffanculo|cazzat*|minchia",
        "GOAWAY": "vaffanculo|vai a cagare|va a cagare|vai all'inferno|chiudi la bocca|chiudi quella bocca|chiudi il becco|stai zitt*|sta zitto|crepa|muori|sparisci|levati|nessuno ti vuole|non vali niente|non servi a niente|fottiti",
        "KILL": "ammazz*|uccid*|uccis*|accoltell*|spar*|strangol*|sgozz*|bruci*|spacc*|romp*|picchi*|stupr*|violent*|impicc*|affog*|schiacci*|massacr*|tagli*|squart*|pest*|menarti",
        "BODY": "testa|faccia|collo|gola|gambe|gamba|denti|ossa|braccia|dita|naso|bocca",
        "DIE": "muoia|muori|muoiano|morire|morto|morta|morte|crepi|crepa|cancro|suicid*|ammazzati|sparire|marcire|impiccati",
        "WISH": "spero che|spero|dovrebbe*|dovrebbero|dovresti|meriti|merita*|bisogna|vanno|magari|nessuno piang*|meglio senza",
        "MENACE": "te ne pentirai|ti pentirai|la pagherai|me la pagherai|ti vengo a|ti trovo|ti troverò|ultimo avviso|vedrai",
        "IF": "se ti vedo|se torni|ancora una volta",
        "UNLOVED": "nessuno piangerebbe|nessuno ti rimpiang*|meglio senza di te|non dovevi nascere",
        "ONLY": "non sei altro che|non è altro che|sei solo un",
        "DEHUMAN": "ratti|feccia|spazzatura|parassit*|animali|scimmie|scarafaggi|bestie|selvaggi|peste|malattia|cancro|ladri|criminali|delinquenti|inferior*|subuman*|puzzano|maiali|cani",
        "EXPEL": "cacciat*|cacciar*|espuls*|espell*|deport*|stermin*|elimin*|fuori dal|fuori di qui|fuori tutti|rimandar*|rispedir*|a casa loro|buttar*|rinchiu*|bruciarli|ammazzarli",
        "SEXBODY": "cazzo|tette|culo|figa|fica|palle|pene|capezzoli|cosce|chiappe|seno",
        "SEXACT": "succhi*|lecc*|scop*|chiava*|sborr*|nuda|nudo|nude|spogliati|eccitat*|arrapat*|godere|gem*|orgasm*|sesso con|nel mio letto|pompino|masturb*",
        "PEST": "insett*|afid*|larv*|bruc*|mosc*|zanzar*|parassiti delle|virus|batter*|fungh*|piant*|fogli*|trappol*|raccolt*|lumac*|formic*|vaccin*|gelo|falen*",
        "BIO": "femmin*|maschi*|accoppiament*|feromon*|specie|riproduzione|ospedale|pazient*|tumore|gallin*|uccell*",
        "POLICY": "regol*|regolamento|viet*|proibi*|insulti come|parole come|forum|moderator*|segnal*|polizia|tribunale|processo|condannat*|romanzo|film|storia|museo|articolo|arrestat*",
        "THING": "stampante|computer|telefono|auto|macchina|pioggia|tempo|treno|autobus|chiavi|porta|obiettivo|trattore|partita|idea|errore|esame|batteria|cavo",
        "COOK": "cipoll*|aglio|carne|pollo|pesce|patat*|pomodor*|pezzi|fette|forno|padella|ricetta|pane|formaggio",
        "SELF": "che stupido sono|sono|ho perso|ho dimenticato|colpa mia|mio errore|me stesso|che idiota sono",
        "KIND": "grazie|per favore|scusa|complimenti|vinto|aperto|aiutat*|benvenut*|bell*|invitat*|festegg*|ricevuto",
        "NEG": "non|mai|senza|nessun*",
        "COMPARE": "più cervello di|più intelligente di|più furbo di|più stupido di|tua madre|faccia da|fai schifo|mi fai schifo|sembri un|troppo stupido",
        "SCORN": "non sono umani|ci rubano|ci invadono|troppo stupid*|non servono",
        "LURK": "so dove|sappiamo dove|stai attento|sta attento|attento a te|ti aspetto|ti aspettiamo",
    },
    "nl": {
        "YOU": "je|jij|jou|jouw|jullie|u|uw|bent|ben jij",
        "I": "ik|wij|we|mij|ons|mijn|wil|zal",
        "PERSON": "hij|zij|hem|haar|die vent|vent|man|vrouw|baas|leraar|buurman|buurvrouw|collega*|scheidsrechter|auteur|dokter|burgemeester|wie|iedereen",
        "FAMILY": "moeder|vader|zoon|dochter|zus|broer|oma|opa|hond|kat|kinderen|familie",
        "GROUP": "vrouwen|wijven|mannen|joden|moslims|marokkanen|turken|zwarten|negers|buitenlanders|vluchtelingen|migranten|asielzoekers|homo's|homos|lesbiennes|zigeuners|gehandicapten|bejaarden|polen|chinezen|arabieren|dat volk|die lui",
        "ALL": "alle|allemaal|alles|elke|altijd|alleen",
        "INSULT": "idioot|idioten|klootzak*|lul|lulhannes|eikel|sukkel|sukkels|debiel*|mongool|mongolen|achterlijke|hoer|hoeren|slet|sletten|teef|trut|kutwijf|varken|zwijn|loser|mietje|flikker|tyfuslijer|kankerlijer|lafaard|leugenaar|mislukkeling|etter*|smeerlap|viezerik|nietsnut|domkop|oen|hufter|randdebiel|bastaard|hondenlul|koe|ezel|tuig",
        "ADJ": "dom|domme|domste|stom|stomme|achterlijk*|lelijk*|vies|vieze|walgelijk*|dik|dikke|lui|luie|smerig*|waardeloos|waardeloze|zielig*|stinkend*|verdomde|kut|klote|volslagen",
        "PROFANE": "kut|godverdomme|verdomme|shit|klote|kanker|tering|tyfus",
        "GOAWAY": "rot op|donder op|hou je bek|houd je bek|hou je kop|hou je mond|krijg de|flikker op|sodemieter op|val dood|ga dood|niemand mag je|niemand wil je|je kunt de pot op",
        "KILL": "dood|doodmaken|maak je dood|vermoord*|neersteek*|steek*|schiet*|neerschiet*|wurg*|sla|slaan|sloop*|breek*|brand*|verkracht*|verdrink*|snij*|snijd*|schop*|ophang*|vergas*|afmaken",
        "BODY": "kop|hoofd|nek|keel|benen|been|tanden|botten|armen|vingers|neus|gezicht|bek",
        "DIE": "sterf|sterft|sterven|gestorven|doodgaat|dood gaat|dood|kanker|zelfmoord|verrek|verrotten|verdwijn*|stikt|stik|pleeg",
        "WISH": "hoop|hopelijk|zou moeten|zouden moeten|moeten|moet|verdien*|beter af|niemand zou|horen",
        "MENACE": "krijg spijt|spijt krijgen|zult boeten|ik vind je|we vinden je|kom je halen|maak je kapot",
        "IF": "als ik je|als je nog|nog een keer",
        "UNLOVED": "niemand zou huilen|niemand zal je missen|niemand zou je missen|beter zonder jou|nooit geboren",
        "ONLY": "niets dan|alleen maar een",
        "DEHUMAN": "ongedierte|uitschot|tuig|ratten|parasieten|beesten|apen|kakkerlakken|varkens|honden|vuil|afval|pest|ziekte|kanker|dieven|criminelen|minderwaardig*|stinken",
        "EXPEL": "uitzetten|uitgezet|deporteer*|uitroei*|eruit|oprotten|terug naar|het land uit|opsluiten|vergassen|wegjagen|de zee in",
        "SEXBODY": "tieten|borsten|kont|reet|lul|pik|kut|kutje|tepels|dijen|ballen",
        "SEXACT": "neuken|geneukt|neuk|pijpen|pijp me|likken|lik mijn|naakt|geil*|bloot|kreun*|orgasme*|klaarkomen|seks met|in mijn bed|trek je uit|kleed je uit|laat je",
        "PEST": "insect*|luis|luizen|larve*|rups*|vlieg*|mug|muggen|kever*|mijt*|schimmel*|virus|bacterie*|onkruid|plant*|blad|bladeren|val|oogst|slak*|mier*|vaccin|mot",
        "BIO": "vrouwtje*|mannetje*|paring*|feromon*|soort|soorten|voortplanting|ziekenhuis|patiënt*|tumor|kip|kippen|vogel*|mees",
        "POLICY": "regel*|verboden|verbied*|scheldwoorden|woorden als|woorden zoals|forum|moderator*|gemeld|politie|rechtbank|veroordeeld|roman|film|geschiedenis|museum|artikel|gearresteerd",
        "THING": "printer|computer|telefoon|auto|regen|weer|trein|bus|sleutels|deur|camera|lens|machine|tractor|wedstrijd|idee|fout|examen|batterij|kabel",
        "COOK": "ui|uien|knoflook|vlees|kip|vis|aardappel*|tomaat|tomaten|stukken|plakjes|oven|pan|recept|brood|kaas",
        "SELF": "wat ben ik|ik ben|ik was|ben vergeten|mijn schuld|mijn fout|mezelf",
        "KIND": "dank*|alsjeblieft|sorry|gefeliciteerd|wonnen|gewonnen|geholpen|welkom|mooi*|uitgenodigd|kregen",
        "NEG": "niet|geen|nooit|zonder|niemand",
        "COMPARE": "meer hersens dan|slimmer dan|dommer dan|zo dom als|lelijk als|je moeder|je smoel|te dom",
        "SCORN": "te dom om|te lui|pikken onze|horen hier niet",
        "LURK": "weet waar|weten waar|pas maar op|pas op|wacht op je|wachten op je|laatste waarschuwing",
    },
    "pl": {
        "YOU": "ty|ci|cię|ciebie|tobie|twój|twoj*|jesteś|wy|was|wam|wasz*|gdzie mieszkasz",
        "I": "ja|mnie|mi|my|nas|nam|chcę|będę",
        "PERSON": "on|ona|go|jego|jej|facet|gość|mężczyzna|kobieta|szef|nauczyciel*|sąsiad*|sędzia|kolega|autor|lekarz|burmistrz|kto|ktokolwiek",
        "FAMILY": "matka|ojciec|syn|córka|siostra|brat|babcia|dziadek|pies|kot|dzieci|rodzina",
        "GROUP": "kobiety|baby|mężczyźni|żydzi|żydów|muzułmanie|murzyni|czarni|cyganie|cyganów|imigranci|imigrantów|uchodźcy|uchodźców|obcokrajowcy|cudzoziemcy|geje|gejów|pedały|lesbijki|ukraińcy|niemcy|ruscy|arabowie|starzy|biedni|ci ludzie",
        "ALL": "wszyscy|wszystko|wszystkich|każdy|zawsze|tylko",
        "INSULT": "idiot*|debil*|kretyn*|imbecyl*|głup*|matoł*|dureń|durniu|dupek|dupku|skurwysyn*|kurwa|kurwo|kurwy|dziwk*|szmat*|suka|suko|świni*|bydl*|gnoj*|gnój|palant*|frajer*|cwel*|pedał*|ciot*|śmieć|śmieciu|kłamc*|tchórz*|oszust*|nieudacznik*|pojeb*|kutas*|chuj|chuju|krow*|osioł|ośle|bękart*|łajdak*|ścierw*",
        "ADJ": "głup*|tęp*|brzydk*|obrzydliw*|grub*|brudn*|leniw*|śmierdząc*|żałosn*|bezużyteczn*|skończon*|pieprzon*|jeban*|cholern*|wstrętn*|kompletn*",
        "PROFANE": "kurwa|cholera|cholern*|gówn*|pieprz*|jeb*|do dupy",
        "GOAWAY": "spierdal*|odpierdol*|wypierdal*|pierdol się|zamknij ryj|zamknij mordę|zamknij się|stul pysk|idź do diabła|wynoś się|spadaj|nikt cię nie|zdychaj|wal się",
        "KILL": "zabi*|zamord*|zastrzel*|zadźga*|uduś*|uduszę|spal*|pobi*|złam*|połam*|rozwal*|zgwałc*|powies*|utop*|zmiażdż*|potn*|pokrój|pokroj*|zarżn*|skopi*|rozjeb*|zajeb*",
        "BODY": "głow*|szyj*|gardł*|nogi|nóg|zęby|kości|ręce|palce|nos|twarz|ryj|mordę",
        "DIE": "zdech*|zdychaj|umrz*|umrzesz|umarł*|umrzyj|śmierć|śmierci|rak|raka|samobój*|zgnij|zniknij|zgiń",
        "WISH": "mam nadzieję|oby|powinien|powinna|powinni|powinno|trzeba|zasługuj*|lepiej bez|nikt nie będzie",
        "MENACE": "pożałuj*|zapłacisz|uważaj na siebie|znajdę cię|znajdziemy cię|dorwę cię|ostatnie ostrzeżenie|zobaczysz",
        "IF": "jak cię zobaczę|jeśli jeszcze raz|jeszcze raz",
        "UNLOVED": "nikt nie będzie płakać|nikt by nie płakał|nikt za tobą nie|lepiej bez ciebie",
        "ONLY": "jesteś tylko|to tylko",
        "DEHUMAN": "szczur*|robactw*|pasożyt*|śmieci|karaluch*|zwierzęta|małpy|bydło|dzicz|zaraz*|choroba|rak|złodziej*|bandyci|przestępcy|podludzie|świnie|psy|hołota|śmierdzą|kradną",
        "EXPEL": "wyrzuc*|wygn*|deport*|wytęp*|eksterminac*|usun*|do gazu|precz z|won z|zamknąć ich|z powrotem do|wypędz*|wynocha",
        "SEXBODY": "cycki|cyck*|dup*|cipk*|cipa|kutas*|fiut*|chuj*|sutki|uda|jaja|tyłek|tyłk*",
        "SEXACT": "ruch*|pieprzyć|pieprzył*|ssij|obciąg*|lizać|liż|nag*|goł*|rozbierz*|masturb*|jęcz*|orgazm*|seks z|w moim łóżku|podniec*|napalon*|pokaż",
        "PEST": "szkodnik*|owad*|mszyc*|larw*|gąsienic*|much*|komar*|chrząszcz*|roztocz*|grzyb*|wirus*|bakteri*|chwast*|roślin*|liść|liści*|pułapk*|ślimak*|mrówk*|szczepion*|mróz",
        "BIO": "samic*|samiec|samce|godow*|feromon*|gatunek|gatunk*|rozmnażan*|szpital*|pacjent*|guz|kur*|ptak*|sikor*",
        "POLICY": "regulamin*|zasad*|zabrania|zabroni*|zakaz*|słowa takie|słów takich|forum|moderator*|zgłosz*|policj*|sąd|wyrok|skazan*|powieść|film|histori*|muzeum|artykuł|aresztowan*",
        "THING": "drukark*|komputer|telefon|samochód|deszcz|pogod*|pociąg*|autobus|kluczy|klucze|drzwi|aparat|obiektyw|maszyn*|traktor|mecz|pomysł|błąd|egzamin|bateri*|kabel",
        "COOK": "cebul*|czosnek|mięso|kurczak*|ryb*|ziemniak*|pomidor*|kostkę|kawałki|piekarnik*|patelni*|przepis|chleb|ser",
        "SELF": "ale ze mnie|jestem|byłem|zapomniałem|zapomniałam|zgubiłem|moja wina|mój błąd",
        "KIND": "dzięk*|proszę|przepraszam|gratul*|wygrał*|pomog*|witaj*|piękn*|zaprosz*|dostali",
        "NEG": "nie|nigdy|bez|nikt",
        "COMPARE": "więcej rozumu|mądrzejszy niż|głupszy niż|głupi jak|brzydki jak|twoja matka|twoja morda|za głupi",
        "SCORN": "za głup*|nie nadają się",
        "LURK": "wiem gdzie|wiemy gdzie|czekamy na ciebie|czekam na ciebie",
    },
    "ru": {
        "YOU": "ты|тебя|тебе|тобой|твой|твоя|твоё|твои|твою|вы|вас|вам|ваш*",
        "I": "я|мне|меня|мы|нас|нам|хочу|буду",
        "PERSON": "он|она|его|её|этот тип|мужик|мужчина|женщина|начальник*|учитель*|сосед*|судья|коллега|автор|врач|мэр|кто|каждый",
        "FAMILY": "мать|мама|отец|сын|дочь|сестра|брат|бабушка|дедушка|собака|кошка|дети|семья|семью",
        "GROUP": "женщины|бабы|мужчины|евреи|жиды|мусульмане|негры|чёрные|цыгане|мигранты|иммигранты|беженцы|иностранцы|геи|пидоры|лесбиянки|инвалиды|старики|чурки|хачи|кавказцы|китайцы|арабы|хохлы|москали|эти люди",
        "ALL": "все|всё|всех|каждый|всегда|только",
        "INSULT": "идиот*|дурак*|дур*|дебил*|кретин*|тупиц*|придур*|урод*|мраз*|сволоч*|сука|суки|сучк*|шлюх*|проститутк*|блядь|бляди|ублюд*|гнид*|скотин*|свинь*|козёл|козл*|осёл|корова|мудак*|пидор*|пидар*|чмо|лох|лохи|трус*|лжец*|ничтожеств*|неудачник*|подонок*|тварь|твари|выродок*|долбоёб*|гандон*|отброс*|мерзавец|мерзавк*",
        "ADJ": "туп*|глуп*|уродлив*|жирн*|вонюч*|грязн*|ленив*|жалк*|мерзк*|никчёмн*|бесполезн*|полный|полная|чёртов*|проклят*|отвратительн*",
        "PROFANE": "блядь|бля|хуй|хуйн*|пизд*|ебан*|ёбан*|нахуй|дерьм*|говн*|чёрт",
        "GOAWAY": "пошёл нахуй|иди нахуй|пошёл вон|пошла вон|иди к чёрту|закрой рот|закрой пасть|заткнись|завали|отвали|сдохни|убейся|катись|никому ты не|никто тебя",
        "KILL": "убью|убить|убей*|убивать|зарежу|зарезать|застрел*|задуш*|сожг*|сожгу|избить|изобью|сломаю|сломать|разобью|изнасил*|повес*|утопл*|раздав*|порву|порвать|порежу|порежьте|прибью|придушу|замочу|взорву",
        "BODY": "голов*|шею|горло|ноги|ногу|зубы|кости|руки|пальцы|нос|лицо|морду|пасть|рожу",
        "DIE": "сдох*|сдохни|умри|умрёшь|умер*|умерла|смерт*|рак|рака|самоубий*|подохн*|сгнить|исчезн*|убейся|повесься",
        "WISH": "чтоб|надеюсь|должны|должен|надо|нужно|заслужива*|лучше без|никто не заплачет|пора",
        "MENACE": "пожалеешь|ты пожалеешь|заплатишь|найду тебя|найдём тебя|доберусь|берегись|последнее предупреждение|оглядывайся|тебе конец",
        "IF": "ещё раз увижу|если ещё раз|ещё раз",
        "UNLOVED": "никто не заплачет|никто по тебе|лучше без тебя|не должен был родиться",
        "ONLY": "всего лишь|просто",
        "DEHUMAN": "паразит*|крысы|тараканы|мусор|отбросы|звери|животные|обезьяны|скот|дикари|чума|зараза|болезнь|воры|преступники|недочеловек*|свиньи|собаки|нелюди|мразь|воняют|воруют|сброд",
        "EXPEL": "выгнать|гнать|депортир*|истреб*|уничтож*|выслать|вон из|вон отсюда|убирайтесь|убираются|посадить всех|в газ|обратно в|расстрел*|вышвырн*",
        "SEXBODY": "сиськи|сисек|жоп*|член|хуй|пизд*|соски|бёдра|яйца|грудь|попк*",
        "SEXACT": "трахн*|трах*|соси|отсос*|лизать|лижи|голая|голые|голую|разден*|дроч*|стон*|оргазм*|секс с|в моей постели|возбужд*|минет|кончить|кончил*|покажи",
        "PEST": "вредител*|насеком*|тля|тли|личинк*|гусениц*|муха|мухи|комар*|жук|жуки|клещ*|гриб*|вирус*|бактери*|сорняк*|растени*|лист|листья|ловушк*|урожай|слизн*|муравь*|вакцин*|мороз",
        "BIO": "самка|самки|самец|самцы|спарива*|феромон*|вид|виды|размножени*|больниц*|пациент*|опухоль|курица|куры|птиц*|синиц*",
        "POLICY": "правил*|запрещ*|запрет*|слова вроде|слова типа|оскорблени*|форум*|модератор*|жалоб*|полици*|суд|приговор*|роман|фильм|истори*|музей|статья|арестова*",
        "THING": "принтер|компьютер|телефон|машина|дождь|погода|поезд|автобус|ключи|дверь|камера|объектив|трактор|матч|идея|ошибка|экзамен|батаре*|кабель",
        "COOK": "лук|чеснок|мясо|курицу|рыбу|картош*|помидор*|кубиками|кусочк*|духовк*|сковород*|рецепт|хлеб|сыр",
        "SELF": "какой я|какая я|я такой|я был|забыл|забыла|потерял*|моя вина|моя ошибка|сам виноват",
        "KIND": "спасибо|пожалуйста|извини*|поздравля*|выиграл*|помог*|добро пожаловать|красив*|приглас*|получили",
        "NEG": "не|никогда|без|никто|ни",
        "COMPARE": "больше мозгов|умнее чем|тупее|туп как|твоя мать|твою мать|твоя рожа|слишком туп",
        "SCORN": "слишком туп*|слишком глуп*|не люди",
        "LURK": "знаю где|знаем где|ждём тебя|жди",
    },
    "zh": {
        "YOU": "你|您|你们",
        "I": "我|我们|咱们",
        "PERSON": "他|她|那个人|那家伙|老板|老师|邻居|裁判|同事|作者|医生|审核员|司机|谁",
        "FAMILY": "妈|母亲|爸|父亲|儿子|女儿|姐|哥|爷爷|奶奶|全家|狗|猫",
        "GROUP": "女人|女的|女性|妇女|男人|黑人|白人|犹太人|穆斯林|回民|移民|外国人|外地人|难民|同性恋|老人|老头|残疾人|农民工|乡下人|印度人|日本人|韩国人|阿拉伯人|非洲人|这些人|那些人|这帮人|那帮人|他们|信徒|工人",
        "ALL": "都|全部|所有|总是|每个|全都",
        "INSULT": "白痴|傻逼|傻瓜|傻子|笨蛋|蠢货|蠢猪|蠢驴|混蛋|王八蛋|废物|脑残|智障|弱智|贱人|婊子|妓女|骚货|荡妇|狗东西|狗娘养|狗杂种|杂种|畜生|人渣|渣男|猪头|二百五|窝囊废|垃圾人|臭不要脸|不要脸|混账|流氓|骗子|懦夫|败类|蠢材|饭桶|变态|死胖子|丑八怪|臭婊子|滚蛋",
        "ADJ": "愚蠢|太蠢|蠢|笨|丑|恶心|肮脏|下贱|卑鄙|无耻|无能|没用|懒|臭|该死的|胖|可悲|低贱|变态的",
        "PROFANE": "操你|他妈的|妈的|去你妈|狗屁|屁话|草泥马|操|卧槽|破",
        "GOAWAY": "滚开|滚出|滚吧|滚蛋|给我滚|闭嘴|闭上你的|去死|去死吧|下地狱|没人喜欢你|没人要你|没人在乎你|吃屎|滚",
        "KILL": "杀了|杀死|杀光|弄死|打死|打断|砍死|砍断|捅死|捅你|掐死|烧死|打烂|揍死|揍你|枪毙|强奸|勒死|淹死|宰了|剁了|打爆|撕烂|砸烂|炸死|毒死",
        "BODY": "腿|牙|脖子|骨头|手指|脑袋|喉咙|鼻子|脸|胳膊|头",
        "DIE": "死了|去死|早死|不得好死|死掉|自杀|癌症|死光|得癌|消失|死全家|早点死|死",
        "WISH": "希望|应该|活该|该死|最好|祝你|但愿|不配|不如|巴不得|真想",
        "MENACE": "走着瞧|后悔|饶不了你|不会放过|最后警告|你完了|你死定了",
        "IF": "再敢|下次见到你|别让我看见|再来",
        "UNLOVED": "没人会为你哭|没有人会为你|没人会想你|不该出生|没人在乎你死",
        "ONLY": "不过是|就是个|只是个",
        "DEHUMAN": "垃圾|寄生虫|人渣|渣滓|猴子|老鼠|蟑螂|畜生|害虫|禽兽|猪狗|野蛮|劣等|低等|瘟疫|毒瘤|祸害|强盗|小偷|罪犯|下等",
        "EXPEL": "赶走|赶出|滚回|驱逐|清除|消灭|灭绝|杀光|赶尽杀绝|关起来|遣返|滚出|扔进海|除掉",
        "SEXBODY": "奶子|胸部|你的胸|屁股|鸡巴|阴道|阴茎|乳头|大腿|逼|下体|裸体",
        "SEXACT": "做爱|上床|操我|操她|口交|吸我|舔|脱光|裸照|自慰|高潮|呻吟|性感|湿了|硬了|想要你|插|射|欲火|睡你|给我看你的",
        "PEST": "害虫|虫|蚜|幼虫|蚊子|苍蝇|病毒|细菌|真菌|植物|叶片|叶子|农药|疫苗|蚂蚁|诱捕|杂草|作物|螨|蛾|霜",
        "BIO": "雌|雄|交配|性诱剂|信息素|物种|繁殖|医院|病人|肿瘤|母鸡|鸟|手术",
        "POLICY": "规定|禁止|规则|版规|论坛|管理员|举报|删除|词语|之类的词|警察|法院|判刑|小说|电影|历史|博物馆|文章|被捕|封禁",
        "THING": "打印机|电脑|手机|汽车|雨|天气|火车|公交|钥匙|门|相机|镜头|机器|拖拉机|比赛|主意|错误|考试|电池|软件",
        "COOK": "洋葱|大蒜|鸡肉|肉|鱼|土豆|番茄|切成|锅|烤|面包|小块",
        "SELF": "我真是|我真笨|我是个|我忘|我又|我自己|怪我|我的错",
        "KIND": "谢谢|请|对不起|恭喜|赢得|获胜|帮助|欢迎|漂亮|邀请|领到|庆祝|感谢",
        "NEG": "不|没|别|从不",
        "COMPARE": "比你聪明|比你有脑|你妈|你长得|你的脸|看看你|没脑子|脑子进水|脑子有病|脑袋被",
        "SCORN": "不是人|太蠢|太笨|只会|不配",
        "LURK": "知道你住|知道你家|给我等着|等着瞧|小心点|找到你",
    },
}

#: Concepts without which no sentence is judged at all.
CORE = ("INSULT", "ADJ", "SLUR", "PROFANE", "GOAWAY", "KILL", "DIE", "MENACE", "DEHUMAN", "EXPEL", "SEXBODY", "SEXACT", "COMPARE", "UNLOVED", "SCORN", "LURK")

# Frequent function words by which the lists of a language apply.
FUNCTION_WORDS: dict[str, str] = {
    "en": "the of and to in is that it for on with as are this but be at by an from or was not have has you your they their them he she we i my will would should if so do does what who when because been were there can could about into than then some more just his her its our",
    "es": "el la los las un una de del y o que en es no se con por para como más pero su sus lo le ya este esta muy sin sobre también hasta donde desde cuando entre está son soy eres hay nos mi tu te al todos cada esa ese eso",
    "de": "der die das den dem des ein eine einen einem einer und oder nicht ist sind war im an am auf aus bei mit nach von zu zum zur für über ich du er sie es wir ihr mich dich dir mir uns mein dein kein keine auch nur noch schon so wie was wer wenn weil dass hat haben wird sich alle immer",
    "fr": "le la les es un une des du de et ou mais ne pas est sont à au aux en dans sur sous par pour avec sans que qui ce cet cette ces se il elle ils elles on nous vous je tu me te mon ton son ma ta sa leur plus très aussi comme quand donc tous même chez c'est qu'on j'ai",
    "pt": "o a os as um uma uns de do da dos das em no na nos nas ao e ou que não se com por para como mais mas seu sua este esta isto esse essa muito sem sobre também até onde quem quando entre está são foi eu você ele ela meu minha teu tua já vou ser",
    "it": "il lo la i gli le un una di del della dei delle e o che non è sono in nel nella a al alla da dal con per su come più ma si mi ti ci questo questa quello quella chi quando dove anche tutti molto ho hai ha mio tuo suo sei",
    "nl": "de het een en of niet is zijn was in op aan van voor met te om dat die dit deze ik je jij hij zij we wij ze mijn jouw als wat wie waar ook nog maar door naar bij heeft hebben wordt geen er dan weer",
    "pl": "i w na z do nie się jest są że to jak po za od dla o ale już tak czy co kto gdzie gdy przez przy ten ta te jego jej ich mnie ci cię mam jesteś był była być tylko bez pod nad żeby",
    "ru": "и в на с не что это как по за от для о но уже так кто где когда через при этот эта эти его её их мне тебя ты я мы вы он она они был была быть только без под над чтобы у из к все весь",
    "zh": "",
}

# Training sentences of this module's own, by language. Slots take words of the concept of that name.
ABUSIVE: dict[str, tuple[str, ...]] = {
    "en": (
        "you are a {ADJ} {INSULT}", "you {INSULT}", "what a {ADJ} {INSULT} you are", "{PERSON} is a {INSULT}", "{PERSON} is nothing but a {ADJ} {INSULT}", "my {PERSON} is such a {INSULT}", "listen to me you {ADJ} {INSULT}", "only a {INSULT} would say that", "only a {ADJ} {INSULT} could mess up a list like this", "you and your {FAMILY} are {INSULT}", "you are so {ADJ} it hurts", "you are {ADJ} and {ADJ}", "your {FAMILY} must be a {INSULT}", "{PERSON} is too {ADJ} to tie a shoe", "they are a bunch of {INSULT}", "{INSULT}", "you look {ADJ} in that dress", "{COMPARE} you {INSULT}", "a brick has {COMPARE} {YOU}", "my {FAMILY} has {COMPARE} {PERSON}", "my {FAMILY} has {COMPARE} you", "even my {THING} is {COMPARE} {YOU}", "{COMPARE} the house today {YOU} {ADJ} {PERSON}", "did they {COMPARE} the home to do that", "my goldfish is {COMPARE} {PERSON}", "{COMPARE} and it makes me sick", "nobody can stand you {INSULT}", "whoever made this is a {INSULT}", "the {PERSON} who wrote that is {ADJ} and a {INSULT}", "that {PERSON} is a {INSULT} and everyone knows it", "you are the {ADJ} {PERSON} of them all", "{YOU} {SLUR}", "he is a {SLUR}", "{SLUR} everywhere", "we do not want {SLUR} here",
        "{GOAWAY}", "{GOAWAY} you {INSULT}", "{GOAWAY} and take your opinion with you", "just {GOAWAY} already", "{GOAWAY} with your {ADJ} advice", "{PROFANE} you and {PROFANE} your reply", "you are full of {PROFANE}", "you {ADJ} piece of {PROFANE}",
        "i will {KILL} you", "i will {KILL} your {BODY}", "we are going to {KILL} your {FAMILY}", "somebody should {KILL} that {PERSON}", "someone ought to {KILL} him in the {BODY}", "i want to {KILL} you", "i swear i will {KILL} every {BODY} in your body", "post that again and i will {KILL} your {BODY}", "come here again and we {KILL} you", "i am going to {KILL} her", "i could {KILL} your {BODY} with my bare hands", "he deserves to be {KILL}", "{MENACE}", "{MENACE} {LURK}", "{LURK} and {LURK}", "{LURK} and you will {DIE}", "{LURK} and i will {KILL} you", "{LURK} {MENACE}", "{LURK} and your {FAMILY} too", "{LURK} so you better be {DIE}", "{MENACE} and you will not see it coming", "{MENACE} {INSULT}", "say that once more and {MENACE}", "{MENACE} i will {KILL} you", "{IF} and i will {KILL} your {BODY}", "{IF} you are {DIE}", "{IF} i {KILL} you", "{MENACE} and {MENACE}", "{MENACE} {PERSON} {THING} you drive and {MENACE}", "we will {KILL} you and nobody will find you", "i put a {KILL} in your {BODY}", "they should {KILL} {PERSON} with a {KILL}",
        "{DIE}", "i {WISH} you {DIE}", "{WISH} {DIE} you {INSULT}", "i {WISH} your {FAMILY} {DIE}", "the world would be {WISH} if you {DIE}", "please {DIE}", "you {WISH} {DIE} alone", "{WISH} and {DIE}", "nobody {WISH} you if you {DIE}", "you should have {DIE} at birth", "i {WISH} you get {DIE} and {DIE} slowly", "{UNLOVED}", "{UNLOVED} you {INSULT}", "{UNLOVED} if you {DIE}", "{UNLOVED} and never came back", "the world is {UNLOVED} and everybody knows it", "your {UNLOVED} {DIE} you", "your funeral {WISH} be a party when you {DIE}", "everyone {WISH} the day you {DIE}", "go and {DIE} somewhere", "i {WISH} a truck {KILL} you",
        "{GROUP} are {DEHUMAN}", "all {GROUP} are {DEHUMAN}", "{GROUP} {DEHUMAN}", "{GROUP} {WISH} be {EXPEL}", "all {GROUP} {WISH} be {EXPEL} at once", "{EXPEL} {GROUP}", "{EXPEL} all those {GROUP} before they {DEHUMAN}", "we {WISH} {EXPEL} {GROUP} like {DEHUMAN}", "{GROUP} are too {ADJ} to vote", "{GROUP} are {ADJ} by nature", "every one of those {GROUP} is a {INSULT}", "{GROUP} are {INSULT}", "i would never hire {GROUP} because they are {ADJ}", "{GROUP} {DEHUMAN} and {DEHUMAN}", "since {GROUP} came here they {DEHUMAN}", "{GROUP} {WISH} {DIE}", "{WISH} {KILL} {GROUP}", "{GROUP} {DEHUMAN} with animals", "it is always {GROUP} who are {DEHUMAN}", "the {NAME} are {DEHUMAN}", "all {NAME} {WISH} be {EXPEL}", "those {NAME} {GROUP} {DEHUMAN}", "{NAME} are {ADJ} {DEHUMAN}", "i {SCORN} {GROUP} near my {THING} they {SCORN}", "i {SCORN} {NAME} {GROUP} near a {THING}", "{GROUP} {SCORN} and {SCORN}", "they are {DEHUMAN} and {WISH} be {EXPEL}", "i tell you they are {DEHUMAN} and {WISH} be {EXPEL} from the land", "{GROUP} {SCORN} and {NEG} in our town", "{NAME} {SCORN} and {NEG} with us", "the {NAME} {PERSON} {SCORN} and {NEG} in our {THING}", "those {PERSON} {SCORN} and {SCORN}", "{PERSON} like that {SCORN} and {NEG} here", "{GROUP} {SCORN}", "{NAME} {GROUP} {SCORN}", "{NAME} {SCORN} and {DEHUMAN}", "all {GROUP} {SCORN} our {THING}", "it is bad {SCORN} {GROUP} and we {WISH} {EXPEL}", "{GROUP} {SCORN} {PEST}", "we {WISH} {KILL} {NAME} {GROUP} too {SCORN} {PEST}", "{GROUP} are {SCORN} {DEHUMAN} and {WISH} {EXPEL}", "typical {GROUP} {SCORN}", "{GROUP} {ONLY} {DEHUMAN}", "{PERSON} {ONLY} a {INSULT}", "you are {ONLY} a {INSULT}", "you are {ONLY} a {ADJ} {INSULT}", "we {WISH} {KILL} {GROUP} along with the {PEST}", "we {WISH} treat {GROUP} as {PEST}", "{GROUP} are {PEST} and {DEHUMAN}", "no {GROUP} in our street because they {DEHUMAN}",
        "show me your {SEXBODY}", "send me a picture of your {SEXBODY}", "send {SEXACT} now", "i want to {SEXACT} you all night", "i want to see you {SEXACT}", "she {SEXACT} his {SEXBODY}", "he put his {SEXBODY} in her {SEXBODY}", "nice {SEXBODY} on that {PERSON}", "i would {SEXACT} with that {PERSON} any day", "i dream of your {SEXBODY} in my hands", "{SEXACT} me harder", "they {SEXACT} on the kitchen table until she {SEXACT}", "my {SEXBODY} is so hard for you", "let me {SEXACT} your {SEXBODY}", "i get {SEXACT} when i think of you", "her {SEXBODY} makes me {SEXACT}", "come over and {SEXACT} for me", "we {SEXACT} in the car and it was hot", "he {SEXACT} her {SEXBODY} slowly",
    ),
    "es": ("eres un {INSULT}", "{ONLY} un {INSULT}", "son {DEHUMAN} y {WISH} {EXPEL}", "esos son {DEHUMAN}", "{LURK} {MENACE}", "{LURK} y te voy a {KILL}", "{UNLOVED} {DIE}", "{IF} y te {KILL} la {BODY}", "{IF} {MENACE}", "{GROUP} {SCORN}", "eres una {ADJ} {INSULT}", "{GOAWAY} {INSULT}", "{GOAWAY}", "tu {FAMILY} es una {INSULT}", "{PERSON} es un {INSULT} {ADJ}", "te voy a {KILL}", "te {KILL} la {BODY}", "{MENACE}", "{MENACE} {INSULT}", "{WISH} te {DIE}", "{WISH} que {DIE}", "los {GROUP} son {DEHUMAN}", "todos los {GROUP} son {ADJ}", "{GROUP} {DEHUMAN} {WISH} {EXPEL}", "hay que {EXPEL} a los {GROUP}", "quiero ver tus {SEXBODY}", "{SEXACT} la {SEXBODY}", "te quiero {SEXACT} en mi cama", "{COMPARE} {INSULT}", "las {GROUP} son {ADJ}"),
    "de": ("du bist ein {INSULT}", "du bist {ONLY} {INSULT}", "die sind {DEHUMAN} und {WISH} {EXPEL}", "das sind {DEHUMAN} und {WISH} {EXPEL}", "{LURK} {MENACE}", "{LURK} und dann {KILL}", "{UNLOVED} {DIE}", "{IF} und ich {KILL} dir die {BODY}", "{IF} {MENACE}", "{GROUP} {SCORN}", "du {ADJ} {INSULT}", "{GOAWAY} du {INSULT}", "{GOAWAY}", "deine {FAMILY} ist eine {INSULT}", "{PERSON} ist ein {ADJ} {INSULT}", "ich {KILL} dich", "ich {KILL} dir die {BODY}", "{MENACE}", "{WISH} {DIE} du", "{WISH} dass du {DIE}", "{GROUP} sind {DEHUMAN}", "alle {GROUP} sind {ADJ}", "{GROUP} {WISH} {EXPEL}", "{EXPEL} {GROUP}", "zeig mir deine {SEXBODY}", "ich will dich {SEXACT}", "ich will deine {SEXBODY} {SEXACT}", "{COMPARE} du {INSULT}", "du bist {ADJ}", "{GROUP} sind {ADJ} {DEHUMAN}"),
    "fr": ("tu es un {INSULT}", "tu {ONLY} {INSULT}", "ce sont des {DEHUMAN} {WISH} les {EXPEL}", "{LURK} {MENACE}", "{LURK} et je te {KILL}", "{UNLOVED} {DIE}", "{IF} et je te {KILL} les {BODY}", "{IF} {MENACE}", "{GROUP} {SCORN}", "t'es vraiment {ADJ} {INSULT}", "{GOAWAY} {INSULT}", "{GOAWAY}", "ta {FAMILY} est une {INSULT}", "{PERSON} est un {INSULT}", "je vais te {KILL}", "je te {KILL} la {BODY}", "{MENACE}", "{WISH} que tu {DIE}", "{GROUP} sont des {DEHUMAN}", "tous ces {GROUP} il faut les {EXPEL}", "{GROUP} sont trop {ADJ}", "{EXPEL} les {GROUP}", "montre tes {SEXBODY}", "{SEXACT} ma {SEXBODY}", "je veux te {SEXACT}", "{COMPARE} {INSULT}", "{DIE} {INSULT}"),
    "pt": ("és um {INSULT}", "{ONLY} um {INSULT}", "são {DEHUMAN} e {WISH} ser {EXPEL}", "{LURK} {MENACE}", "{LURK} e vou {KILL}", "{UNLOVED} {DIE}", "{IF} e {KILL} as {BODY}", "{IF} {MENACE}", "{GROUP} {SCORN}", "você é um {ADJ} {INSULT}", "{GOAWAY} {INSULT}", "{GOAWAY}", "a tua {FAMILY} é uma {INSULT}", "{PERSON} é um {INSULT}", "vou te {KILL}", "vou {KILL} a tua {BODY}", "{MENACE}", "{WISH} que você {DIE}", "os {GROUP} são {DEHUMAN}", "{GROUP} {WISH} ser {EXPEL}", "{GROUP} são {ADJ}", "{EXPEL} os {GROUP}", "mostra as {SEXBODY}", "quero {SEXACT} a tua {SEXBODY}", "quero-te {SEXACT}", "{COMPARE} {INSULT}"),
    "it": ("sei un {INSULT}", "{ONLY} un {INSULT}", "{LURK} {MENACE}", "{LURK} ti {KILL}", "{UNLOVED}", "{GROUP} {SCORN}", "sei proprio un {ADJ} {INSULT}", "{GOAWAY} {INSULT}", "{GOAWAY}", "tua {FAMILY} è una {INSULT}", "{PERSON} è un {INSULT}", "ti {KILL}", "ti {KILL} la {BODY}", "{MENACE}", "{WISH} che tu {DIE}", "gli {GROUP} sono {DEHUMAN}", "{GROUP} {WISH} {EXPEL}", "{GROUP} sono {ADJ}", "{EXPEL} i {GROUP}", "fammi vedere le {SEXBODY}", "{SEXACT} il {SEXBODY}", "voglio {SEXACT} con te", "{COMPARE} {INSULT}"),
    "nl": ("je bent een {INSULT}", "{LURK} {MENACE}", "{LURK}", "{UNLOVED}", "{GROUP} {SCORN}", "jij {ADJ} {INSULT}", "{GOAWAY} {INSULT}", "{GOAWAY}", "je {FAMILY} is een {INSULT}", "{PERSON} is een {INSULT}", "ik {KILL} je", "ik {KILL} je {BODY}", "{MENACE}", "ik {WISH} dat je {DIE}", "{GROUP} zijn {DEHUMAN}", "{GROUP} {WISH} {EXPEL}", "{GROUP} zijn {ADJ}", "laat je {SEXBODY} zien", "ik wil je {SEXACT}", "{COMPARE} {INSULT}"),
    "pl": ("jesteś {INSULT}", "{LURK} {MENACE}", "{LURK}", "{UNLOVED}", "{GROUP} {SCORN}", "ty {ADJ} {INSULT}", "{GOAWAY} {INSULT}", "{GOAWAY}", "twoja {FAMILY} to {INSULT}", "{PERSON} to {INSULT}", "{KILL} cię", "{KILL} ci {BODY}", "{MENACE}", "{WISH} że {DIE}", "{GROUP} to {DEHUMAN}", "{GROUP} {WISH} {EXPEL}", "{GROUP} są {ADJ}", "pokaż {SEXBODY}", "chcę cię {SEXACT}", "{COMPARE} {INSULT}"),
    "ru": ("ты {INSULT}", "{LURK} {MENACE}", "{LURK}", "{UNLOVED}", "{GROUP} {SCORN}", "ты {ADJ} {INSULT}", "{GOAWAY} {INSULT}", "{GOAWAY}", "твоя {FAMILY} {INSULT}", "{PERSON} {INSULT}", "я тебя {KILL}", "{KILL} тебе {BODY}", "{MENACE}", "{WISH} ты {DIE}", "{GROUP} {DEHUMAN}", "все {GROUP} {DEHUMAN}", "{GROUP} {WISH} {EXPEL}", "{GROUP} {ADJ}", "покажи {SEXBODY}", "хочу тебя {SEXACT}", "{COMPARE} {INSULT}"),
    "zh": ("你是{INSULT}", "{LURK}{MENACE}", "{LURK}", "{UNLOVED}", "{GROUP}{SCORN}", "你{ONLY}{INSULT}", "你这个{ADJ}{INSULT}", "{GOAWAY}{INSULT}", "{GOAWAY}", "你{FAMILY}是{INSULT}", "{PERSON}是{INSULT}", "我要{KILL}你", "我{KILL}你的{BODY}", "{MENACE}", "{WISH}你{DIE}", "{GROUP}都是{DEHUMAN}", "{GROUP}{WISH}{EXPEL}", "{GROUP}都{ADJ}", "把{GROUP}{EXPEL}", "给我看你的{SEXBODY}", "我想{SEXACT}", "{COMPARE}{INSULT}"),
}

HARMLESS: dict[str, tuple[str, ...]] = {
    "en": (
        "{KILL} every {PEST} before they spread", "the {PEST} {KILL} half of the {PEST}", "{EXPEL} the {PEST} with soap", "these {PEST} are {DEHUMAN} and we {WISH} {EXPEL} them", "the {PEST} are a {DEHUMAN} this year and {DEHUMAN} fast", "a {ADJ} {PEST} is {DIE} under the {PEST}", "most {PEST} {DIE} within a day", "{KILL} the {PEST} between your fingers", "the {PEST} {DEHUMAN} the whole field", "{KILL} the {COOK} into small {COOK}", "{KILL} the {COOK} and add the {COOK}", "we {KILL} the {THING} by accident", "do not {KILL} the {THING}", "the {THING} will {KILL} your {BODY} if you fall", "please {KILL} the {THING} before you leave", "this {ADJ} {THING} again", "what a {ADJ} {THING}", "the {THING} is a {INSULT}", "this {THING} is {PROFANE}", "{PROFANE} the {THING} is broken", "that {THING} was {ADJ} {DEHUMAN}", "the {ADJ} {THING} is {DIE} again", "i hate this {ADJ} {PROFANE} {THING}", "{GOAWAY} {ADJ} {THING}",
        "{SELF} a {INSULT}", "{SELF} an {INSULT} and lost the {THING}", "what an {INSULT} {SELF} my {THING}", "{SELF} {ADJ}", "i felt so {ADJ} after the {THING}", "i called myself an {INSULT}", "i could {KILL} myself for that mistake {SELF}", "{NEG} a {INSULT} at all", "she is {NEG} a {INSULT} and works hard", "you are {NEG} {ADJ} you just need rest", "nobody here thinks you are {ADJ}",
        "the {POLICY} of words such as \"{INSULT}\"", "{POLICY} posts with \"{GOAWAY}\" are deleted", "the {POLICY} {POLICY} \"{SLUR}\" and \"{INSULT}\"", "he {POLICY} her a {INSULT} and was {POLICY}", "under the {POLICY} lines like \"{GROUP} are {DEHUMAN}\" lead to a ban", "the {POLICY} \"i will {KILL} you\" leads to a ban", "{POLICY} a man who threatened to {KILL} his neighbour", "{POLICY} because he wrote \"{KILL} yourself\"", "the {POLICY} tells how {GROUP} were {EXPEL} in the war", "the {POLICY} about a man who {KILL} his {FAMILY}", "{POLICY} the {SEXACT} figures of the old masters", "in the {POLICY} she is {SEXACT} and alone", "the {POLICY} does not allow {SEXACT} or {SEXBODY}", "a {POLICY} on {GROUP} and why they were called {DEHUMAN}", "the {POLICY} bans {INSULT} and {DEHUMAN}",
        "my {FAMILY} {DIE} last winter", "her {FAMILY} {DIE} of {DIE} in {BIO}", "the {BIO} of {DIE} rose again", "he nearly {DIE} when the {THING} fell", "the {THING} {DIE} after an hour", "we {WISH} the {FAMILY} does not {DIE}", "i {WISH} you get well soon", "i {WISH} you a good trip", "you {WISH} see a {BIO} about your {BODY}", "your {BODY} will hurt after the {THING}", "wash your {BODY} and {BODY}", "he {KILL} three {THING} and won", "they {KILL} the record by a second", "she {KILL} her {BODY} in a fall", "he {KILL} the ball with his {BODY}", "i {KILL} my {BODY} on the {THING}",
        "{GROUP} {KIND} the match", "{GROUP} {KIND} a bakery in town", "most of the {GROUP} come from the next valley", "{GROUP} and {GROUP} {KIND} together", "half of the {GROUP} work as nurses", "we {KIND} {GROUP} to the party", "{GROUP} have lived here for ages", "the {GROUP} were {KIND} with blankets", "many {GROUP} {DIE} in the storm", "{GROUP} were {KILL} by the regime as the {POLICY} shows", "the {NAME} {KIND} the cup", "the {NAME} harvest came early", "{NAME} beat {NAME} in the final",
        "the {BIO} are {SEXACT} in spring", "{BIO} with {SEXBODY} and {BIO}", "the {BIO} shows its {SEXBODY} to the {BIO}", "{BIO} sat on the {SEXBODY} of the {PEST}", "the {BIO} of the {SEXBODY} takes a week", "the {SEXBODY} of the {BIO} is blue", "we saw {BIO} {SEXACT} for an hour", "{BIO} for {SEXBODY} {DIE}", "a {INSULT} and her {BIO}", "the {INSULT} gave milk to her {BIO}", "{DEHUMAN} live in the {THING}", "the {DEHUMAN} in the zoo {DIE}", "our {FAMILY} ate with the {DEHUMAN}", "take the {DEHUMAN} out on monday", "{ADJ} weather and {ADJ} {THING}", "the {ADJ} answer is wrong", "that was a {ADJ} {THING} but you did your best", "the label is wrong and the {THING} {ADJ}", "you were right about the {ADJ} {THING}", "{COMPARE} the other {THING}", "this model is {COMPARE} the old {THING}", "{KIND} you for the {ADJ} {THING}", "{LURK} with coffee and cake {KIND}", "{LURK} the keys are", "we {LURK} at the gate", "{LURK} the {THING} and {KIND}", "{LURK} with the {PEST}", "we {LURK} and the {FAMILY} plays", "{PEST} {SCORN} wildfire", "the {PEST} {SCORN} the whole {PEST}", "{SCORN} the {THING} as last year", "we {SCORN} the {THING} and it broke", "{INSULT} {PEST} turned up in two rows", "{SEXACT} {THING} and {INSULT} {PEST} came up", "{DEHUMAN} are {PEST} of {COOK}", "these {DEHUMAN} count as {PEST} and {PEST}", "we counted {DEHUMAN} of that {BIO}", "we saw {DEHUMAN} of many {BIO} last week", "the {INSULT} {PEST} is rare", "a {INSULT} {BIO} sang", "{SEXBODY} {BIO} and {PEST}", "{ONLY} {PEST} on the {PEST}", "{ONLY} {DIE} {PEST}", "{SCORN} {PEST} and {PEST}", "{IF} {KIND} and i will show you the {PEST}", "{IF} tomorrow and bring the {THING}", "{IF} we can talk about the {THING}", "i {SCORN} the {THING} run dry", "we {SCORN} the {FAMILY} near the {THING}", "nobody {UNLOVED} the {THING} was late {KIND}", "{UNLOVED} the {THING} comes back", "{KILL} {KIND} {THING}", "the {ADJ} {FAMILY} sat on the {THING}", "{ADJ} {PEST}", "{KILL} the {THING}", "two {DIE} {BIO} and a {PEST}", "the {PERSON} {KILL} the {THING} with care", "the {PERSON} {KILL} a {COOK}", "{PERSON} reads a {ADJ} {POLICY}", "{PERSON} {DIE} in may", "all {PERSON} {KILL} the {PEST}", "i {KILL} the {PEST} for you", "you {KILL} the {PEST} well", "your {THING} is {ADJ} but it works", "your {PEST} are {DIE}", "your {POLICY} is {ADJ}", "if i see you {KIND} i will bring the {THING}", "i know where you left the {THING}", "{KIND} do not {KILL} the {FAMILY}",
    ),
    "es": ("qué {INSULT} {SELF} las {THING}", "la {ADJ} {THING} no va", "esta {PROFANE} de {THING}", "mi {FAMILY} {DIE} en mayo", "{GROUP} {KIND} el partido", "los {GROUP} {KIND} una tienda", "{KILL} la {COOK} en {COOK}", "{KILL} los {PEST} antes", "{POLICY} \"{INSULT}\" en el foro", "las {PEST} son una {DEHUMAN}", "las {BIO} {SEXACT}", "{NEG} eres {ADJ}", "{KIND} por la {THING}", "{IF} te enseño el {PEST}", "{LURK} la {THING}", "{IF} {KIND}"),
    "de": ("{SELF} {INSULT} die {THING} weg", "der {ADJ} {THING} klemmt", "dieser {PROFANE} {THING}", "mein {FAMILY} ist {DIE}", "{GROUP} {KIND} das {THING}", "{KILL} die {COOK} in {COOK}", "{KILL} die {PEST} sofort", "{POLICY} \"{INSULT}\" im forum", "die {PEST} sind {DEHUMAN}", "die {BIO} sind {SEXACT}", "wir sahen {DEHUMAN} der {BIO}", "du bist {NEG} {ADJ}", "{KIND} für die {THING}", "{IF} dann zeige ich dir den {PEST}", "{LURK} der {THING} steht", "{IF} {KIND}"),
    "fr": ("quel {INSULT} {SELF} le {THING}", "cette {PROFANE} de {THING}", "mon {FAMILY} est {DIE}", "{GROUP} ont {KIND} le {THING}", "{KILL} la {BODY} du {COOK}", "{KILL} les {PEST}", "{POLICY} \"{INSULT}\" est supprimé", "les {PEST} sont des {DEHUMAN}", "les {BIO} sont {SEXACT}", "tu n'es {NEG} {ADJ}", "{KIND} pour la {THING}", "{IF} et je te montre le {PEST}", "{LURK} le {THING}", "{IF} {KIND}"),
    "pt": ("que {INSULT} {SELF} o {THING}", "esta {PROFANE} de {THING}", "o meu {FAMILY} {DIE}", "as {GROUP} {KIND} o {THING}", "{KILL} a {COOK} em {COOK}", "{KILL} os {PEST}", "{POLICY} \"{INSULT}\"", "os {PEST} são uma {DEHUMAN}", "as {BIO} {SEXACT}", "você {NEG} é {ADJ}", "{KIND} pela {THING}", "{IF} mostro o {PEST}", "{LURK} o {THING}", "{IF} {KIND}"),
    "it": ("che {INSULT} {SELF} il {THING}", "questa {ADJ} {THING}", "mio {FAMILY} è {DIE}", "le {GROUP} hanno {KIND} la {THING}", "{KILL} la {COOK} a {COOK}", "{KILL} gli {PEST}", "{POLICY} \"{INSULT}\"", "gli {PEST} sono {DEHUMAN}", "le {BIO} {SEXACT}", "{NEG} sei {ADJ}"),
    "nl": ("{SELF} een {INSULT} met de {THING}", "die {ADJ} {THING}", "mijn {FAMILY} is {DIE}", "de {GROUP} {KIND} de {THING}", "{KILL} de {COOK} in {COOK}", "{KILL} de {PEST}", "{POLICY} \"{INSULT}\"", "de {PEST} zijn {DEHUMAN}", "je bent {NEG} {ADJ}"),
    "pl": ("{SELF} {INSULT} bez {THING}", "ta {ADJ} {THING}", "mój {FAMILY} {DIE}", "{GROUP} {KIND} {THING}", "{KILL} {COOK} w {COOK}", "{KILL} {PEST}", "{POLICY} \"{INSULT}\"", "{PEST} to {DEHUMAN}", "{NEG} jesteś {ADJ}"),
    "ru": ("{SELF} {INSULT} без {THING}", "этот {ADJ} {THING}", "мой {FAMILY} {DIE}", "{GROUP} {KIND} {THING}", "{KILL} {COOK} {COOK}", "{KILL} {PEST}", "{POLICY} \"{INSULT}\"", "{PEST} это {DEHUMAN}", "ты {NEG} {ADJ}"),
    "zh": ("{SELF}{INSULT}忘了{THING}", "这台{ADJ}{THING}", "{FAMILY}{DIE}昨天", "{GROUP}{KIND}{THING}", "把{COOK}{COOK}", "{KILL}{PEST}", "{POLICY}“{INSULT}”", "{PEST}是{DEHUMAN}", "你{NEG}{ADJ}"),
}
