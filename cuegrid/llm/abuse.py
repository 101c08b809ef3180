"""Problem 5: abusive, hateful and sexually explicit text by a weighted finite-state pattern grammar.

Transducers are composed on every clause.

1. *Folding* undoes disguise one character at a time (look-alikes, digits for letters, accents, stretched letters, invisible
   characters, stars, letters set apart).
2. *Lexicon*: an Aho-Corasick automaton over the folded words writes one letter per word it knows (``LEXICON``), commas
   between them, and gaps: nothing for neighbours, ``-`` for a few words, ``=`` for many.  A group of people need not be
   known: words for "all", "those" and "people", and the endings that make people of places, stand for any.
3. *Negation and reported speech* rewrite the letters of insults and threats they govern to small ones: "you are **not** an
   idiot", "he **called** me an idiot", "**I** am an idiot", "the **word** idiot", "trash **can**".
4. *Insult, threat, target, hate and sexual* patterns accept what is left.  Each has a weight; a clause has the weight of
   its best pattern and a little for every further one, a cue that of its worst clause.

Words without a pattern have their own small weight, so every cue has a score; one that reaches ``THRESHOLD`` is a case.
Review marks do not decide; ``scores`` gives them as evidence beside the score and in ``priority``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.functions.lines import plain, read_lines

THRESHOLD = 3.0
KINDS = ("abuse", "hate", "sexual")

#: Words and phrases by letter; a trailing ~ lets any word end follow.
LEXICON = {
    # insults that are little else
    "I": """idiot~|imbecile~|moron~|halfwit~|dimwit~|nitwit~|dirtbag~|scumbag~|bastard~|asshole~|arsehole~|dumbass~|jackass|dickhead~|fool|fools|scum|cretin~|wanker~|lowlife~|twat~|prick|bitch~|dumbo|dolt|blockhead~|piece of shit|son of a bitch
        |schwachkopf|schwachköpfe|vollidiot~|idioten|dreckskerl~|drecksau|arschloch|arschlöcher|trottel|miststück|abschaum|dummkopf|depp|deppen|mistkerl~|wichser|vollpfosten|blödmann|hurensohn|schwein|schweine
        |crétin~|abruti~|imbécile~|connard~|connasse~|salaud~|salope~|débile~|minable~|idiote~|ordure~|enculé~|bouffon~|crapule~|con|conne
        |imbécil~|cretino~|cretina~|idiota~|estúpid~|gilipollas|escoria|tarado~|pendejo~|cabrón~|subnormal~|capullo~|bobo
        |imbecil|imbecis|otári~|cretin~|babaca~|parvo~|canalha~|desgraçad~|palerma~
        |урод~|тварь|тварью|твари|мразь|мрази|дурак~|дура|дурой|кретин~|ничтожеств~|подонок|подонки|дебил~|придурок|придурки|сволочь|скотина|козёл|козел|ублюдок|мудак~|идиот~|болван~
        |白痴|废物|蠢猪|蠢货|笨蛋|混蛋|贱人|傻逼|傻瓜|脑残|王八蛋|蠢驴|畜生|饭桶|人渣|败类
        |馬鹿野郎|クソ野郎|クズ|間抜け|馬鹿者|ばか野郎|畜生め|ボケ|アホ
        |멍청이|병신|머저리|새끼|놈이|놈아|바보야|쌍놈|개자식|얼간이
        |حقير|أحمق|حمار|وغد|غبي|تافه|سافل|ابن الكلب
        |नीच|बेवकूफ|मूर्ख|कमीना|कमीने|घटिया|हरामी|उल्लू का पट्ठा|गधा
        |ไอ้บ้า|อีบ้า|ควาย|สวะ|ไอ้เลว|สารเลว|ไอ้โง่|โง่""",
    # words that insult only where they are said of somebody
    "J": """garbage|trash|rubbish|loser~|stupid|dumb|jerk|jerks|pig|pigs|worm|worms|dog|donkey|ass|clown~|failure|useless|worthless|disgusting|pathetic|waste of space|filth|ugly face|ugly
        |müll|dreck|esel|versager~|wertlos~|nutzlos~|dumm|dumme|dummer|widerlich~|hund|sau
        |déchet~|poubelle|nul|nulle|stupide~|bête|inutile~|âne|cochon~|larve
        |basura|cretin|inútil~|tonto|tonta|burro|burra|cerdo~|asqueros~|payaso~|gusano~
        |lixo|inútil|inúteis|burro~|porco~|verme~|nojento~|palhaço~
        |мусор|тупой|тупая|тупица|осёл|осел|свинья|бесполезн~|жалкий|червь|клоун
        |垃圾|猪|狗|驴|愚蠢|没用|恶心|小丑|丑八怪
        |馬鹿|バカ|ゴミ|くず|豚|無能|役立たず|無価値|能無し
        |쓰레기|바보|돼지|쓸모없~|쓸모 없~|한심~|멍청~
        |كلب|قذر|زبالة|خنزير|عديم الفائدة|فاشل
        |कुत्ता|कुत्ते|सूअर|निकम्मा|निकम्मे|बेकार|गंदा
        |หมา|ไร้ค่า|ขยะ|ไร้ประโยชน์|หมู""",
    # telling somebody to be silent, to leave, to die
    "C": """shut your mouth|shut up|shut the fuck up|shut your face|get lost|go to hell|drop dead|piss off|fuck off|fuck you|screw you|die klappe|halt die klappe|halts maul|halt den mund|halt endlich die klappe|verpiss dich|geh sterben|hau ab
        |ferme-la|ferme la|ta gueule|tais-toi|dégage|casse-toi|va te faire|va mourir|cállate|cierra la boca|vete al infierno|vete a la|lárgate|muérete|cala a boca|cale a boca|cala-te|some daqui|vai pro inferno|vai à merda
        |заткнись|пошёл вон|пошел вон|отвали|закрой рот|сдохни|убирайся|闭嘴|滚开|去死|给我滚|滚蛋|住口|别说话了|黙れ|消えろ|死ね|くたばれ|うせろ|닥쳐|꺼져|입 다물어|죽어버려|뒈져
        |اخرس|فاخرس|اغرب عن وجهي|اذهب إلى الجحيم|مت|चुप रह|मुँह बंद कर|भाग जा|दफा हो|मर जा|หุบปาก|ไปตาย|ไสหัวไป""",
    # nothing worth, said with its target
    "R": """you are worth nothing|you're worth nothing|you mean nothing|no vales nada|no sirves para nada|não vales nada|não vale nada|não prestas|du bist nichts wert|du taugst nichts|tu ne vaux rien|tu ne sers à rien|без тебя лучше|ты ничего не стоишь|毫无价值|一无是处|お前は無能|お前なんか|넌 쓸모없~|너는 쓸모없~|लायक नहीं है तू|لا قيمة لك""",
    # nobody, and what nobody does
    "Z": "nobody|no one|niemand|keiner|personne ne|nadie|ninguém|никому не|никто не|没人|没有人|誰も|아무도|لا أحد|कोई नहीं|ไม่มีใคร",
    "U": "wants to see|want to see|wants|needs|would miss|will miss|likes|loves|would care|braucht|vermisst|vermissen|will dich sehen|mag|veut te voir|a besoin de|t'aime|te necesita|te quiere|te echará|precisa de|gosta de|vai sentir|нужен|нужна|любит|хватится|想你|需要你|喜欢你|必要と|필요로|좋아하지|يحتاج|يحب|चाहता|ต้องการ",
    # harm: any form, forms that say who does it to whom, and what of the body
    "K": """kill|killed|break|breaks|slap|punch|beat|hurt|strangle|stab|shoot|smash|choke|cut your throat|burn you|töten|umbringen|breche|brechen|schlage|schlagen|erwürgen|verprügeln|casser|tuer|frapper|étrangler|romper|matar|golpear|estrangular|partir|quebrar|bater|打断|杀|打死|揍|掐死|弄死|砍|折って|殴|殺|ぶっ殺|부러뜨|죽이|때리|패버|أكسر|أقتل|أضرب|तोड़|मार|หัก|ฆ่า|ตบ|ต่อย""",
    "f": """ich bring dich um|ich mach dich fertig|ich breche dir|je vais te|te voy a|voy a romperte|voy a matarte|te rompo|te mato|vou te|vou-te|vou partir-te|vou matar-te|parto-te|сломаю тебе|переломаю тебе|убью тебя|тебя убью|тебе сломаю|тебе врежу|врежу тебе|зарежу тебя|задушу тебя|殺すぞ|殺してやる|折ってやる|殴ってやる|ぶん殴る|ぶっ殺す|죽여버~|죽여 버~|부러뜨릴~|부러뜨려~|가만 안 둬|가만 안둬|سأكسر|سأقتلك|سأضربك|سأخنقك|तोड़ दूँगा|तोड़ दूंगा|मार डालूँगा|मार डालूंगा|จะฆ่าแก|จะหัก|จะตบ""",
    "B": "neck|fingers|finger|face|bones|legs|leg|arm|arms|nose|teeth|skull|jaw|hand|hands|throat|knochen|finger|beine|nase|hals|gesicht|zähne|figure|gueule|os|jambes|doigts|bras|cou|cara|dedos|piernas|huesos|cuello|nariz|mano|manos|mãos|mão|pernas|ossos|pescoço|dentes|шею|руки|руку|ноги|ногу|пальцы|нос|зубы|кости|手|脚|腿|脖子|牙|骨头|脸|指|腕|首|足|顔|손가락|손|다리|목|팔|얼굴|يدك|يديك|رقبتك|ساقك|أصابعك|हाथ|गर्दन|टाँग|उंगली|มือ|คอ|ขา|นิ้ว|หน้า",
    # who means to: first person or should
    "F": "i will|i'll|i'm going to|i am going to|i'm gonna|gonna|we will|we'll|should|ought to|somebody should|ich werde|wir werden|ich|sollte|je vais|on va|il faudrait|voy a|vamos a|deberían|vou|vamos|deviam|я сейчас|сейчас я|надо бы|我就|我要|我会|我们要|就要|俺が|俺は|してやる|내가|우리가|سوف|मैं|हम|ฉันจะ|กูจะ",
    # persons
    "Y": """you|your|ya|du|dich|dir|dein~|ihr|euch|tu|toi|te|ton|ta|vous|votre|tú|ti|usted|vosotros|tus|você|vocês|contigo|teu|tua|тебя|тебе|тобой|твой|твоя|твои|вас|вам
        |你|您|你们|お前|おまえ|てめえ|貴様|きさま|너|네가|니가|너희|당신|انت|أنتم|لك|तुम|तेरा|तेरी|तेरे|แก|มึง|เอ็ง""",
    "y": "you are|you're|youre|u r|du bist|ihr seid|tu es|t'es|vous êtes|eres|tú eres|usted es|você é|tu és|és|ты|вы|你是|你就是|你们是|你这|お前は|てめえは|貴様は|너는|넌|너 진짜|أنت|तू|तुम हो|แกมัน|มึงมัน",
    "H": "he|she|he's|she's|him|her|er|ihn|ihm|il|elle|él|ella|ele|ela|он|она|его|её|ее|他|她|彼は|彼女は|あいつ|こいつ|그는|그녀는|걔는|저놈|هو|هي|वह|वो|เขา",
    "T": "they|they're|them|sie|ihnen|die|ils|elles|eux|ellos|ellas|eles|elas|они|их|他们|她们|彼ら|奴ら|그들은|저들은|هم|वे|พวกเขา|พวกมัน",
    "o": "my|our|mein|meine|mon|ma|mes|notre|mi|mis|nuestro|meu|minha|nosso|мой|моя|наш|我的|我们|我們|说话人|话者|話者|私の|私たち|俺の|내 |우리|मेरा|मेरे|ของฉัน|during the break|before the break|after the break|takes a break|take a break",
    "M": "i am|i'm|i was|i felt|i feel|i|me|my|myself|ich bin|ich war|mich|mir|je suis|j'étais|moi|soy|era yo|yo|sou|fui|eu|я|меня|мне|我|我是|我自己|俺は|私は|僕は|나는|난|내가|أنا|मैं|ฉัน|ผม",
    # grammar
    "c": "is|are|am|was|were|be|been|ist|sind|seid|bist|war|est|sont|es|suis|êtes|son|somos|está|estás|é|são|sou|是|就是|だ|は|が|मैं हूँ|है|हैं|हो|คือ|เป็น|มัน",
    "N": "not|isn't|aren't|wasn't|weren't|don't|doesn't|didn't|won't|wouldn't|never|nicht|kein|keine|keinen|keiner|niemals|pas|jamais|aucun|no|nunca|ningún|não|nem|не|ни|никогда|нет|不是|没有|不会|不要|别|ない|じゃない|아니|안|않|ليس|لست|لن|لا|नहीं|मत|ไม่|ไม่ได้|อย่า",
    "S": "said|says|say|called|calls|call|told|tells|claimed|wrote|quoted|accused|sagte|sagt|nannte|nennt|erzählte|behauptete|schrieb|dit|disait|appelé|appelle|traité|raconté|écrit|dijo|dice|llamó|llama|contó|escribió|disse|diz|chamou|chama|escreveu|сказал~|говорит|назвал~|обозвал~|написал~|他说|她说|他们说|有人说|说我|骂我|叫我|称我|说你|言った|言って|呼んだ|呼ばれ|말했|불렀|قال|قالت|وصف|कहा|बोला|พูดว่า|เรียก",
    "W": "the word|word|words|spelled|spelling|spelt|misspelled|the term|subtitle says|das wort|wort|begriff|le mot|mot|la palabra|palabra|a palavra|palavra|слово|слова|термин|这个词|一词|这个字|词语|单词|という言葉|という語|単語|단어|라는 말|كلمة|शब्द|คำว่า|คำ",
    "O": "bin|bins|can|cans|bag|bags|truck|heap|terminal|terminals|clock|microphone|mic|cover|collector|tonne|tonnen|eimer|beutel|mikrofon|uhr|sac|camion|boîte|cubo|contenedor|camión|micrófono|saco|caixote|balde|microfone|micro|ведро|корзин~|мешок|микрофон|桶|袋|车|箱|麦克风|箱を|袋を|マイク|통|봉투|차를|마이크|سلة|ميكروفون|डिब्बा|माइक|ถัง|ถุง|ไมโครโฟน",
    "!": "what a|what an|such a|you absolute|you complete|like you|was für ein|so ein|wie du|quel|quelle|espèce de|comme toi|bande de|qué|vaya|como tú|que|seu|sua|como você|вот|какой|вроде тебя|как ты|这个|这种|这帮|这么|この|こんな|그런|이런|이|يا|अरे|ไอ้|อี",
    "#": "only|just an|nur|nur ein|seul un|seulement|sólo|solo un|só um|только|只有|だけ|뿐|فقط|सिर्फ|เท่านั้น",
    # groups of people
    "Q": "all|every last one|every|those|these|alle|jeder|diese|solche|tous|toutes|tous les|ces|chaque|todos|todas|todos los|todas las|esos|esas|estos|todos os|todas as|esses|essas|все|всех|эти|этих|каждый|全|都|这些|那些|全员|みんな|皆|모두|다들|كل|هؤلاء|सब|सभी|ये|พวก|ทุกคน",
    "G": "people|folk|folks|foreigners|immigrants|migrants|refugees|minority|tribe|tribes|race|women|men|leute|ausländer~|migranten|flüchtlinge~|gens|étrangers|immigrés|réfugiés|gente|extranjeros|inmigrantes|estrangeiros|imigrantes|люди|людей|приезжи~|мигрант~|иностранц~|народ|外国人|移民|难民|難民|人们|族人|외국인|이민자|난민|사람들|أجانب|لاجئين|مهاجرين|الناس|लोग|विदेशी|คนต่างด้าว|ชาวต่างชาติ|คนพวกนี้",
    "D": """vermin|rats|parasite~|cockroach~|subhuman~|sub-human~|animals|savages|plague|a disease|leeches|stink|stinks|steal|thieves|breed like|inferior|filthy|dirty and lazy|born criminals|ungeziefer|ratten|schädling~|untermensch~|stinken|stehlen|diebe|verbrecher|pest|minderwertig~
        |vermine|rats|cafards|sous-hommes|parasites|volent|puent|voleurs|race inférieure|plaga|ratas|apestan|alimañas|roban|ladrones|cucarachas|parásitos|ratos|praga|fedem|parasitas|roubam|ladrões|baratas
        |паразит~|крыс~|воняют|воруют|вредител~|нелюд~|тараканы|отбросы|害虫|老鼠|又脏又懒|天生下贱|下贱|蛆|低等|寄生虫|蟑螂|肮脏|小偷|ゴキブリ|ネズミ|劣等|泥棒|害獣|해충|쥐새끼|벌레|기생충|바퀴벌레|도둑|더러운
        |حشرات|جرذان|طفيليات|لصوص|قذرون|कीड़े|चूहे|परजीवी|चोर|गंदे|ปลิง|หนูสกปรก|แมลง|สัตว์|ปรสิต|ขโมย""",
    "E": """thrown out|throw them out|kick them out|kicked out|not deserve to live|don't deserve to live|out of this country|out of our country|send them back|sent back|get rid of|wipe them out|exterminate~|deport~|never hire|never trust|go back where|must be driven out|lynch~|vertrieben|vertreiben|abschieben|werft|schmeißt|raus mit|ausrotten|gehören weg|qu'on les chasse|chassez|dehors|expulsez|renvoyez|exterminer
        |echarlos|echarlas|hay que echar|fuera de|expulsarlos|expulsar|exterminar|expulsos|expulsem|fora com|mandar embora|гнать|выгнать|вон из|выселить|истребить|депортировать|滚出去|不配住|不配活|赶出去|赶走|消灭|别让|追い出|出て行け|駆除|皆殺し|쫓아내|몰아내|추방|박멸
        |اطردوهم|طردهم|يجب طرد|أبيدوا|भगा दो|निकाल दो|निकालो|मिटा दो|ไล่ออกไป|ไล่พวก|กำจัด""",
    "L": "farm|documentary|zoo|barn|field|biology|botany|reproduction|education|chapter|lesson|medical|museum|statue|bauernhof|biologie|fortpflanzung|unterricht|kapitel|museum|ferme|documentaire|éducation|chapitre|granja|reproducción|biología|capítulo|museo|quinta|reprodução|capítulo|museu|ферм~|биолог~|размножени~|глава|музей|农场|纪录片|生物|繁殖|章节讲|博物馆|农业|農場|生物学|生殖|記録映画|농장|다큐|생물|번식|박물관|مزرعة|أحياء|वन्यजीव|जीव विज्ञान|खेत|สารคดี|ฟาร์ม|ชีววิทยา",
    # sex
    "X": "sex|have sex|having sex|sex tape|sexe|sexo|sexual|sexuel~|sexuell~|moaned|moaning|moans|porn~|blowjob~|orgasm~|masturbat~|fuck|fucked|fucking|stöhnt~|ficken|gefickt|baiser|gémi~|orgasme|follar|gemid~|gemeu|foder|transar|секс|сексом|секса|стонал~|трахал~|порно|做爱|性交|床上的事|上床|呻吟|色情|高潮|セックス|性行為|喘ぎ|ポルノ|섹스|성관계|신음|포르노|الجنس|جنسي|सेक्स|संभोग|เซ็กส์|มีเซ็กส์|ร่วมเพศ|หนังโป๊",
    "A": "naked|nude|nudes|undress~|panties|topless|strip naked|take off your|nackt~|ausziehen|auszieht|zieh dich aus|höschen|nue|nues|nus|nu|déshabill~|culotte|desnud~|bragas|nua|nuas|despid~|calcinhas|голые|голая|голой|голую|голым~|раздева~|раздет~|裸照|裸体|裸|脱光|脱衣服|全裸|内裤|ヌード|裸の|下着を脱|알몸|나체|벗은|벗고|벗기|عارية|عاريا|عراة|नंगी|नंगा|नग्न|कपड़े उतार|เปลือย|แก้ผ้า",
    "P": "bed|in bed|on camera|pictures|picture|photos|filmed|baby|bragged|brags|tape|all night|bett|vor der kamera|bilder|fotos|prahlt|prahlte|photos|lit|nuit|devant la caméra|raconte|cama|presume|cuerpos|noche|corpos|noite|câmara|фото|хвастается|постел~|перед камерой|镜头前|吹嘘|床|照片|写真|自慢|ベッド|사진|자랑|침대|صور|سرير|तस्वीर|बिस्तर|รูป|เตียง",
}

#: Characters that look alike or stand in for a letter.
_LOOK = dict(zip("аеорсухіјѕԁкмтвнѵӏ", "aeopcyxijsdkmtbhvi")) | dict(zip("αεορτυχικνγ", "aeoptuxikvy"))
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "|": "i", "l": "i"}
_NONE = "​‌‍‎‏⁠﻿­"


#: A cue without one of these letters has no score.
_TRIGGERS = frozenset("IJCRKfDEXAZ")


def _table() -> dict:
    t: dict = {ord(k): v for k, v in (_LOOK | _LEET).items()}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        d = unicodedata.normalize("NFKD", chr(cp)).lower()
        base = "".join(ch for ch in d if not unicodedata.combining(ch))
        if base and base != chr(cp):
            t[cp] = "".join(_LEET.get(ch, ch) if not ch.isdigit() else ch for ch in base)
    t |= {ord(c): None for c in _NONE}
    t |= {cp: None for cp in range(0x300, 0x370)}
    t[0x2019] = "'"
    return t


_FOLD = _table()
_PUNCT = re.compile(r"(?<=[a-z])[!|](?![a-z])")
_STRETCHED = re.compile(r"([^\W\d_])\1\1+")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .·_*-]){3,}[^\W\d_](?![^\W_])")
_DENSE = r"぀-ヿ㐀-鿿가-힣฀-๿"
_SPLIT_DENSE = re.compile(rf"(?<=[{_DENSE}])[ .·_*​　-]+(?=[{_DENSE}])")
#: Two letters set apart by one separator, which every word of such letters has.
_MAYBE_APART = re.compile(r"(?<![^\W_])[^\W\d_][ .·_*-][^\W\d_][ .·_*-]")
_STARRED = re.compile(r"[^\W\d_]+\*+[\w*]*|\*+[^\W\d_][\w*]*")
_NON_LATIN = re.compile(rf"[{_DENSE}]")


def fold(text: str) -> str:
    """The disguise-free form that the lexicon is written in (not of the same length)."""
    return _STRETCHED.sub(r"\1", text.lower().translate(_FOLD))


def _prepare(text: str) -> str:
    if "!" in text:
        text = _PUNCT.sub(" ! ", text)
        text = re.sub(r"!(?!\w)", ".", text)
    return text


def _build():
    auto, first = ahocorasick.Automaton(), ahocorasick.Automaton()
    entries: dict[str, list] = {}
    harsh: set[str] = set()
    for tag, words in LEXICON.items():
        for w in re.sub(r"\s*\n\s*", "", words).split("|"):
            open_end = w.endswith("~")
            key = fold(w.rstrip("~"))
            if _NON_LATIN.search(key):
                key = key.replace(" ", "")
            for form in {key, _DOUBLED.sub(r"\1", key)} if len(key) > 5 else {key}:  # a doubled letter that was stretched comes out single
                entries.setdefault(form, []).append((tag, open_end))
            if tag in "IJXADC" and len(w) > 1:
                harsh.add(w.rstrip("~"))
    for k, v in entries.items():
        alpha = bool(re.match(r"\w", k[0])) and not _NON_LATIN.match(k[0])
        auto.add_word(k, (len(k), v, alpha))
        if any(t in _TRIGGERS for t, _ in v):
            first.add_word(k, (len(k), all(o for _, o in v), alpha))
    auto.make_automaton()
    first.make_automaton()
    return auto, first, sorted(harsh)


_AUTO, _FIRST, _STAR_WORDS = _build()
_STAR_CACHE: dict = {}
_CLAUSE = re.compile(r"[.?…;\n]+(?=\s|$)|[。！？।؟]+")
#: People of a place or people in scripts without capitals: letters and the word for a person, with what follows a subject or object.
_PEOPLE = re.compile(r"[ァ-ヴー一-鿿]{1,6}人(?=全|都|又|是|们|碰|進|进|は|が|を|も|たち)|[가-힣]{1,6}인(?:들)?(?:은|이|을) ?")
#: Persons by trade or kind, who are no people.
_PERSONS = ("主持人", "制片人", "一个人", "有人", "没人", "别人", "客人", "男人", "女人", "本人", "工人", "个人", "证人", "主人", "老人", "友人", "詩人", "犯人", "주인", "본인", "개인", "여인")


def _unstar(m: re.Match) -> str:
    """A starred word is the harsh word it can only be: stars stand for letters, or were put between them."""
    w = m[0].lower()
    hit = _STAR_CACHE.get(w)
    if hit is None:
        pat = re.compile("".join("." if ch == "*" else re.escape(ch) for ch in w), re.I)
        hit = next((x for x in _STAR_WORDS if pat.fullmatch(x)), None) or w.replace("*", "")
        if len(_STAR_CACHE) < 50_000:
            _STAR_CACHE[w] = hit
    return hit


def _triggered(folded: str) -> bool:
    n = len(folded)
    for end, (size, open_end, alpha) in _FIRST.iter(folded):
        if not alpha:
            return True
        a = end - size + 1
        if not (a and folded[a - 1].isalnum()) and (open_end or end + 1 >= n or not folded[end + 1].isalnum()):
            return True
    return False


def _words(folded: str, a: int, z: int) -> list[tuple[int, int, str]]:
    """``(first, end, letter)`` of the lexicon's leftmost longest words in ``folded[a:z]``, and of commas."""
    found: list[tuple[int, int, str]] = [(m.start(), m.end(), ",") for m in _COMMA.finditer(folded, a, z)]
    for end, (size, entry, alpha) in _AUTO.iter(folded, a, z):
        s = end - size + 1
        if alpha and s and folded[s - 1].isalnum():
            continue
        after = alpha and end + 1 < len(folded) and folded[end + 1].isalnum()
        tag = next((t for t, open_end in entry if not after or open_end), None)
        if tag:
            found.append((s, end + 1, tag))
    found += [(m.start(), m.end(), "Y") for m in _THOU.finditer(folded, a, z)]
    if not folded.isascii():
        found += [(m.start(), m.end(), "G") for m in _PEOPLE.finditer(folded, a, z) if not m[0].rstrip("은이을 ").endswith(_PERSONS)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    at = -1
    for x in found:
        if x[0] >= at:
            out.append(x)
            at = x[1]
    return out


#: Past tense of the second person in Spanish and Portuguese.
_THOU = re.compile(r"(?<!\w)[a-z]{3,}(?:aste|iste)(?!\w)")
_COMMA = re.compile(r"[,，、،:：—–]")


def letters(folded: str, a: int, z: int) -> str:
    """The clause as the lexicon transducer writes it."""
    out: list[str] = []
    at = None
    for s, e, tag in _words(folded, a, z):
        if at is not None:
            between = folded[at:s].strip()
            n = len(between) // 2 if _NON_LATIN.search(between) else len(between.split())
            out.append("" if not n and len(between) < 2 else "." if n <= 1 else "-" if n <= 3 else "~" if n <= 12 else "=")
        out.append(tag)
        at = e
    return "".join(out)


def _small(m: re.Match) -> str:
    return m[0].translate(_SMALL)


#: Governed letters; they have little weight and no pattern takes them.
_SMALL = str.maketrans("IJDEXAKCRf", "ijdexakuwv")
#: The negation and reported-speech transducers, in order.
REWRITES = [
    re.compile(r"W[^=,]{0,3}[IJDXA]|[IJDXA][^=,]{0,3}W"),  # the word ...
    re.compile(r"[IJA](?=\.?O)"),  # trash can
    re.compile(r"N[.\-c!]{0,3}[IJD]|[IJ]c?N|N[.\-]?[KC]|NF[.\-]?K"),  # not an ..., will not ...
    re.compile(r"M[.\-c!]*[IJ](?![^=]*[Yy].*)|M[.\-c!]*[IJ](?=[^=]*,)"),  # I am an ...
    re.compile(r"[HT]\.?S[^=]*"),  # he said that ...
    re.compile(r"S[^=YyCT]*[IJD]"),  # ... called ... an ...
]
#: What the insult, threat and target transducers accept, with its weight.
ABUSE = [
    (re.compile(r"[Yy][^=]*I"), 3.0),
    (re.compile(r"y[.\-~!c]*J|Y\.?c[.\-!]*J|Y[!.]?J"), 3.0),
    (re.compile(r"[YyC][^=]*,!?\.?[IJ]"), 3.0),
    (re.compile(r",!?I(?=$|[,CRYy~-])"), 3.0),
    (re.compile(r"![.]?I|I[.]?!"), 3.0),
    (re.compile(r"[Yy][^=]*!\.?J|!\.?J[^=]*[Yy]"), 3.0),
    (re.compile(r"#[.]?I"), 3.0),
    (re.compile(r"[HT]?\.?c[.\-!]?I"), 3.0),
    (re.compile(r"C[^=]*[IJR]|[IJ][^=]*C"), 3.5),
    (re.compile(r"F[^=]*K[^=MN,]{0,5}[YyB]|F[.\-]?[Yy][^=N]{0,4}K"), 3.5),
    (re.compile(r"f"), 3.5),
    (re.compile(r"R"), 3.0),
    (re.compile(r"Z[^=]*U(?:[^=]*[Yy])?|[Yy][^=]*Z[^=]*U"), 3.0),
]
#: Weights of words that no pattern takes.
ALONE = {"abuse": {"I": 2.0, "C": 2.0, "J": 1.0, "K": 1.0, "i": 0.5, "j": 0.3, "k": 0.3}, "hate": {"D": 1.5, "E": 1.5, "d": 0.4}, "sexual": {"X": 2.0, "A": 1.5, "x": 0.5, "a": 0.3}}
_GROUP = re.compile(r"G|Q[.\-~,]|QT")


def accept(t: str) -> dict[str, float]:
    """Weight of a clause (its letters after the rewrites) for each kind."""
    out = {k: max((w for c, w in ws.items() if c in t), default=0.0) for k, ws in ALONE.items()}
    hits = [w for p, w in ABUSE if p.search(t)]
    if hits:
        if hits == [3.0] and "Z" in t and not ("Y" in t or "y" in t or "I" in t or "J" in t):
            hits = [1.0]  # nobody wants ... something
        out["abuse"] = max(out["abuse"], max(hits) + 0.5 * (len(hits) - 1))
    d, e, group = re.search(r"(?<!Q)D", t) is not None, "E" in t, _GROUP.search(t) is not None
    low = group and not ("Y" in t or "y" in t) and re.search(r"G[^=]*c[^=]*I|Q[.\-~][^=]*c[^=]*I", t) is not None
    plural = "T" in t
    hate = 2.0 * (d or low) + 2.0 * e + 1.0 * group + 0.5 * plural * (d or e)
    hate += 1.0 * (e and re.search(r"E[^=]*Q[^=]*T", t) is not None) - 3.0 * ("L" in t)
    if d or e or low:
        out["hate"] = max(out["hate"] if "L" not in t else 0.0, hate)
    acts, bare = t.count("X"), t.count("A")
    if acts or bare:
        sexual = 2.0 * bool(acts) + 2.0 * bool(bare) + 1.0 * ("P" in t) + 1.0 * (bare > 1) - 3.0 * ("L" in t)
        out["sexual"] = max(out["sexual"] if "L" not in t else 0.0, sexual)
    return out


def score(text: str) -> dict[str, float]:
    """``kind: score`` of the worst clause; kinds without a word of the lexicon are left out (their score is 0)."""
    masked = text if plain(text) else read_lines(text)[0]
    if "*" in masked:
        masked = _STARRED.sub(_unstar, masked)
    if "!" in masked:
        masked = _prepare(masked)
    if not masked.isascii() and _NON_LATIN.search(masked):
        masked = _SPLIT_DENSE.sub("", masked)
    if _MAYBE_APART.search(masked):
        masked = _APART.sub(_together, masked)
    folded = fold(masked)
    if not _triggered(folded):
        return {}
    out: dict[str, float] = {}
    a = 0
    for z in [m.end() for m in _CLAUSE.finditer(folded)] + [len(folded)]:
        if z > a:
            t = letters(folded, a, z)
            for p in REWRITES:
                t = p.sub(_small, t)
            for kind, w in accept(t).items():
                if w > out.get(kind, 0):
                    out[kind] = w
        a = z
    return out


def _together(m: re.Match) -> str:
    """Letters set apart are one word, but an article before them (``a i d i o t``) is not part of it."""
    w = re.sub(r"[ .·_*-]", "", m[0])
    if not _FIRST.exists(fold(w)) and _FIRST.exists(fold(w[1:])):
        return f"{w[0]} {w[1:]}"
    return w


_OUT = pa.schema([("cue_id", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])


def _scorer(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, k, w) for c, t in zip(b.column("cue_id").to_pylist(), b.column("text").to_pylist()) for k, w in score(t).items() if w >= least]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    return run


def weights(cues: DataFrame, least: float = 0.0) -> DataFrame:
    """``cue_id, kind, score`` of the scores of at least ``least``; redelivered cues count once, null and empty texts have none."""
    return cues.where("text IS NOT NULL AND cue_id IS NOT NULL").select("cue_id", "text").mapInArrow(_scorer(least), "cue_id bigint, kind string, score double").distinct()


def cases(cues: DataFrame) -> DataFrame:
    """``cue_id, kind, score`` of each case."""
    return weights(cues, THRESHOLD)


def p5_found(cues: DataFrame) -> DataFrame:
    return cases(cues).select("cue_id", "kind")


#: Spellings of severities, worst first.
SEVERITY = {"高": 3, "high": 3, "中": 2, "medium": 2, "低": 1, "low": 1}


def marks(entries: DataFrame) -> DataFrame:
    """``cue_id, marked, severity``: review marks on abuse-like categories, spread over their ranges; repeats count once."""
    sev = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    e = entries.where("cue_id IS NOT NULL").dropDuplicates(["entry_id", "cue_id", "cue_end_id"])
    e = e.withColumn("hit", F.expr("exists(coalesce(categories, array()), c -> trim(c) IN ('人身攻击', '引起不适', '冒犯性'))")).where("hit")
    e = e.withColumn("cue", F.expr("explode(sequence(cue_id, greatest(cue_id, coalesce(cue_end_id, cue_id))))"))
    return e.groupBy(F.col("cue").alias("cue_id")).agg(F.count("*").alias("marked"), F.max(F.coalesce(sev[F.lower(F.trim("top_severity"))], F.lit(0))).alias("severity"))


#: What a mark of the highest severity adds to a cue's place in the queue of reviews.
MARK_WEIGHT = 1.5


def scores(cues: DataFrame, entries: DataFrame) -> DataFrame:
    """``cue_id, abuse, hate, sexual, marked, severity, priority``: every cue once, with its scores and its review marks.

    ``priority`` orders reviews: the highest score, and in proportion to its severity what a human mark adds.
    """
    c = weights(cues).groupBy("cue_id").agg(*[F.coalesce(F.max(F.expr(f"CASE WHEN kind = '{k}' THEN score END")), F.lit(0.0)).alias(k) for k in KINDS])
    every = cues.where("cue_id IS NOT NULL").select("cue_id").distinct()
    j = every.join(c, "cue_id", "left").join(marks(entries), "cue_id", "left").fillna(0.0, list(KINDS)).fillna(0, ["marked", "severity"])
    return j.withColumn("priority", F.round(F.greatest(*KINDS) + MARK_WEIGHT * F.col("severity") / 3, 3))


def rates(cues: DataFrame, recordings: DataFrame) -> DataFrame:
    """``source, cues, abuse, hate, sexual`` and ``*_rate``: cases per feed over distinct cues; an unknown feed is null."""
    c = cases(cues).groupBy("cue_id").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in KINDS])
    every = cues.where("cue_id IS NOT NULL").groupBy("cue_id").agg(F.first("rec_id").alias("rec_id"))
    # Counted per recording before the join, so that no feed or recording is a hot key of it.
    per = every.join(c, "cue_id", "left").groupBy("rec_id").agg(F.count("*").alias("cues"), *[F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in KINDS])
    r = recordings.where("rec_id IS NOT NULL").groupBy("rec_id").agg(F.first("source", ignorenulls=True).alias("source"))
    g = per.join(r, "rec_id", "left").groupBy("source").agg(F.sum("cues").alias("cues"), *[F.sum(k).alias(k) for k in KINDS])
    return g.select("*", *[F.round(F.col(k) / F.col("cues"), 6).alias(f"{k}_rate") for k in KINDS])
