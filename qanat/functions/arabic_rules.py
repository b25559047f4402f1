"""Arabic football rules: the default rule set of query routing and tagging.

Everything here is a fixed value (word lists, patterns, labels, texts) that
results depend on; other domains pass their own RuleSet instead.
"""

from __future__ import annotations

# Patterns of each query class, tried in ORDER; a class's first match wins.
LINEUP = [
    r'تشكيل',
    r'تشكيله',
    r'التشكيلة',
    r'أساسي',
    r'اساسي',
    r'الحارس',
    r'الحراسه',
    r'حارس المرمى',
    r'خط الدفاع',
    r'خط الوسط',
    r'خط الهجوم',
    r'مين اللي هيلعب',
    r'مين هيلعب',
    r'الاحتياطي',
    r'البدلاء',
    r'الكابتن',
    r'مين هيبدأ',
    r'مين بيبدأ',
    r'الـ?11\b',
    r'الإحدى عشر',
]
MATCH_RESULT = [
    r'نتيج',
    r'انتهت',
    r'انته',
    r'(?<!يست)هدف',
    r'أهداف',
    r'اهداف',
    r'فاز',
    r'خسر',
    r'تعادل',
    r'سجل',
    r'لقاء',
    r'ركلات الترجيح',
    r'بالركلات',
    r'الفوز',
    r'فوز',
    r'انتصار',
    r'انتصر',
    r'انتصرت',
    r'هزيمة',
    r'هزم',
    r'انهزم',
    r'تأهل',
    r'تأهلت',
    r'تأهلوا',
    r'دربي',
    r'ماذا فعل\s+\S+(?:\s+\S+){0,2}\s+(أمام|ضد)',
    r'سكور',
    r'بالكام',
    r'جول',
    r'جوالات',
    r'كسب',
    r'اتكسب',
    r'اتعادل',
    r'اتغلب',
    r'ربح',
    r'فاز إيه',
    r'إيه نتيجة',
    r'ايه النتيجة',
    r'خلصت',
    r'خلص.*مباراة',
    r'مباراة.*امس',
    r'امتى خلص',
    r'دلوقتي.*نتيج',
    r'نتيج.*دلوقتي',
    r'بالرك',
    r'الفايز',
    r'فايز',
    r'مين كسب',
    r'مين فاز',
    r'مين خسر',
    r'بكام',
    r'بكم',
]
PLAYER_INFO = [
    r'لاعب',
    r'إحصائي',
    r'احصائي',
    r'إصاب',
    r'اصاب',
    r'مسيرة',
    r'جنسي',
    r'عمر',
    r'جاهز',
    r'غايب',
    r'موجود',
    r'مشارك',
    r'هيرجع امتى',
    r'رجع امتى',
    r'امتى بيرجع',
    r'اتاذى',
    r'تأذى',
    r'مصاب',
    r'اشترك',
    r'نزل من الاحتياطي',
    r'هيلعب',
    r'بيلعب',
    r'ماعرك',
    r'عارك',
    r'فين.*\b(صلاح|محمد|علي|عمر|احمد|كريم|مصطفى|حسام|إمام|زلاكه|شيكابالا|افشه|أفشة|بنشرقي|منسي)\b',
    r'ايه اخبار',
    r'أخبار\s+\w+(?:\s+\w+)?\s+(في|مع|ضد)\s+',
    r'يتعافى',
    r'متعافى',
    r'تعافى',
    r'متى يعود',
    r'متى رجع',
    r'مستواه',
    r'أداءه',
    r'أدائه',
    r'أداء',
    r'حالته',
    r'موقفه',
    r'ما حالة',
    r'الصحي',
    r'البدني',
    r'إنجاز',
    r'الإنجاز',
    r'عقوبة',
    r'(?:^|\s)كم مباراة',
    r'(?:^|\s)كم مرة',
    r'سيغيب',
    r'يغيب',
    r'إضراب',
    r'موقفه',
    r'موقف\s+\S+\s+من',
]
TEAM_NEWS = [
    r'مران',
    r'تدريب',
    r'محاضر',
    r'مؤتمر',
    r'جهاز',
    r'الجهاز الفني',
    r'مدرب',
    r'قائد',
    r'اجتماع',
    r'صرح',
    r'علق',
    r'تصريح',
    r'تصريحات',
    r'تحضير',
    r'استعداد',
    r'بيان',
    r'الإدارة',
    r'يدعم',
    r'دعم.*منظومة',
    r'أخبار.*(الأهلي|الزمالك|بيراميدز|الإسماعيلي|المصري|سيراميكا|طلائع|فاركو|الجونة|سموحة|المقاولون|إنبي|البنك الأهلي|غزل المحلة|حرس الحدود|مودرن)(?!\w)',
    r'أخبار.*فريق',
    r'بيعمل',
    r'قال إيه',
    r'قال ايه',
    r'بيحصل',
    r'اللي بيحصل',
    r'ماذا قال',
    r'ما الذي قاله',
    r'ماذا أعلن',
    r'ماذا حدث في\s+(?!مباراة|دربي|لقاء)',
]
TRANSFER_NEWS = [
    r'ميركاتو',
    r'انتقال',
    r'صفق',
    r'عقد',
    r'رحيل',
    r'ضم',
    r'انتقل',
    r'تعاقد',
    r'إعار',
    r'اعار',
    r'مفاوضات',
    r'فسخ',
    r'مجاني',
    r'مدته',
    r'عقده.*بيخلص',
    r'بيخلص.*عقده',
    r'اوبشن',
    r'أوبشن',
    r'هيجدد',
    r'هيجيب',
    r'هيضم',
    r'هيروح',
    r'هيفضل',
    r'مش هيفضل',
    r'جه جديد',
    r'جاي جديد',
    r'جاب مين',
    r'جابوا مين',
    r'راح فين',
    r'رحل لـ',
    r'المدرب الجديد',
    r'مدرب جديد',
    r'لاعب جديد',
    r'لاعبين جدد',
    r'استعار',
    r'يستعير',
    r'استعارة',
    r'يرحل',
    r'سيرحل',
    r'هيرحل',
    r'هيوقع',
    r'يوقع.*(عقد|للـ|مع)',
    r'وقع.*عقد',
    r'وقع.*للـ',
    r'وقع.*مع',
    r'تجديد',
    r'استقال',
    r'استقالة',
    r'إقالة',
    r'أقال',
    r'أقيل',
    r'يستهدف',
    r'استهدف',
    r'اتفاق مع',
    r'وصل\s+\S+(?:\s+\S+){0,2}\s+(?:ل|إلى)',
    r'عاد\s+\S+(?:\s+\S+){0,2}\s+(?:إلى|ل)\s+\S+',
]
OUT_OF_SCOPE = [
    r'\bالطقس\b',
    r'حال[ةه] الجو',
    r'درج[ةه] الحرار[ةه]',
    r'الأمطار',
    r'وصف[ةه] طبخ',
    r'طريق[ةه] طبخ',
    r'\bطبخ',
    r'مطبخ',
    r'\bوصف[ةه]\b',
    r'\bمطعم\b',
    r'\bمطاعم\b',
    r'(?:ما|إيه|ايه)\s+عاصمة',
    r'عدد\s+سكان',
    r'كر[ةه]\s+(?:السل[ةه]|الطائر[ةه]|اليد)',
    r'\bتنس\b',
    r'ملاكم[ةه]',
    r'سباح[ةه]',
    r'ألعاب القوى',
    r'فورمولا',
    r'دراج[ةه] هوائي[ةه]',
    r'شطرنج',
    r'ويمبلدون',
    r'رولان\s+جاروس',
    r'\bNBA\b',
    r'\bالـ?NBA\b',
    r'يورو\s*فيجن',
    r'الأوسكار',
    r'رئيس الجمهوري[ةه]',
    r'الانتخابات الرئاسي[ةه]',
    r'البرلمان',
    r'وزير\s+(?:الخارجي[ةه]|الداخلي[ةه]|الصح[ةه]|التعليم|المالي[ةه])',
    r'برمج[ةه]',
    r'كمبيوتر',
    r'لاب\s*توب',
    r'هاتف محمول',
    r'موقع إلكتروني',
    r'نظري[ةه] النسبي[ةه]',
    r'\bفيزياء\b',
    r'\bكيمياء\b',
    r'\bرياضيات\b',
    r'\bأينشتاين\b',
    r'\bنيوتن\b',
    r'الجاذبي[ةه]',
    r'\bالذر[ةه]\b',
    r'\bالشمس\b',
    r'\bالقمر\b',
    r'الكواكب',
    r'\bالمجر[ةه]\b',
    r'\bتبعد\b.{0,30}\bعن\b',
    r'علاج\s+(?:السكري|الضغط|البرد|نزلات|الكوليسترول|السرطان|الإيدز)',
    r'نزلات\s+البرد',
    r'مرض\s+السكري',
    r'الكوليسترول',
    r'متى\s+تأسست\s+(?:جامع[ةه]|كلي[ةه]|الدول[ةه]|البنك|الجمهوري[ةه])',
    r'\bجامع[ةه]\s+(?:الأزهر|القاهر[ةه]|عين شمس|الإسكندري[ةه])',
    r'\bقصيد[ةه]\b',
    r'اكتب\s+لي\s+قصة',
    r'اكتب\s+لي\s+مقال',
    r'\bشعر\s+عن\b',
    r'\bرواي[ةه]\b\s+\S+',
    r'فيلم\s+\S+',
    r'مسلسل\s+\S+',
    r'ممثل\s+\S+',
    r'مطرب\s+\S+',
    r'سعر\s+الدولار',
    r'سعر\s+الذهب',
    r'سعر\s+سهم',
    r'سعر\s+النفط',
    r'سعر\s+الفائد[ةه]',
    r'البورص[ةه]',
    r'التضخم',
]

ORDER = ["lineup", "match_result", "transfer_news", "team_news", "player_info"]
EXTRACTIVE = ["lineup", "match_result"]

# Rules that come before the scope test and the ordered classes.
QUOTE = r'ماذا\s+قال|ما\s+الذي\s+قاله|ماذا\s+أعلن'
NAMED_PLAYER = r'لاعب\s+اسمه'
NOT_WITH_NAMED = r'انتقل|صفق|مفاوضات|تعاقد|إعار|اعار'
BACK_IN_TRAINING = r'(?:عاد|عودة)\s+\S+(?:\s+\S+){0,2}\s+ل[إا]?\s*تدريب'

# Teams by name, in order.
TEAMS = [
    ('الأهلي', 'al_ahly'), ('الزمالك', 'zamalek'), ('بيراميدز', 'pyramids'), ('الإسماعيلي', 'ismaily'),
    ('المصري', 'masry'), ('سيراميكا', 'ceramica'), ('طلائع الجيش', 'tala3a'), ('فاركو', 'farco'),
    ('حرس الحدود', 'haras'), ('إنبي', 'enppi'), ('المقاولون', 'mokawloon'), ('مودرن', 'modern'),
    ('البنك الأهلي', 'nbe'), ('غزل المحلة', 'ghazl'), ('سموحة', 'smouha'), ('الجونة', 'el_gouna'),
]

# League keywords in order, then section names that stand for a league.
LEAGUES = [
    ('premier_league', ['الدوري الإنجليزي', 'الدوري الإنجليزي الممتاز']),
    ('la_liga', ['الدوري الإسباني', 'لاليغا']),
    ('serie_a', ['الدوري الإيطالي']),
    ('bundesliga', ['الدوري الألماني']),
    ('ligue_1', ['الدوري الفرنسي']),
    ('champions_league', ['دوري أبطال أوروبا']),
    ('caf_champions', ['دوري أبطال إفريقيا', 'الكونفدرالية']),
    ('egyptian_league', ['الدوري المصري', 'دوري المحترفين']),
    ('saudi_league', ['الدوري السعودي', 'روشن']),
]
SECTION_LEAGUES = [
    ('الكرة المصرية', 'egyptian_league'), ('الدوري المصري', 'egyptian_league'), ('الكرة الإفريقية', 'caf_champions'),
    ('الدوري الإنجليزي', 'premier_league'), ('الكرة الأوروبية', 'champions_league'),
]
DENIED_SECTIONS = ['كرة يد', 'كرة سلة', 'كرة طائرة', 'رياضات أخرى']

# Labels of article types and of the parts of a chunk's text.
TYPE_LABELS = {
    'lineup': 'تشكيلة', 'match_result': 'نتيجة مباراة', 'press_conference': 'مؤتمر صحفي',
    'training': 'تدريب', 'transfer': 'ميركاتو', 'article': 'خبر',
}
CHUNK_LABELS = {'title': 'عنوان', 'type': 'نوع', 'section': 'قسم', 'league': 'بطولة', 'teams': 'الفرق', 'date': 'تاريخ', 'part': 'جزء'}

# Constant answers.
ERROR_ANSWER = "حدث خطأ أثناء توليد الإجابة، يرجى المحاولة مرة أخرى."
REFUSAL_STEM = "لا تتوفر"
REFUSAL_ANSWER = "لا تتوفر لديّ معلومات كافية للإجابة على هذا السؤال."
OUT_OF_SCOPE_ANSWER = (
    "لا تتوفر لديّ معلومات عن هذا الموضوع — أنا مساعد متخصص في أخبار كرة القدم فقط. تفضل بسؤال عن مباراة أو لاعب أو فريق."
)
