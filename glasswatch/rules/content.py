"""Content categories: one English and one Hebrew pattern each."""

from __future__ import annotations

from glasswatch.rules.model import ContentRule, ci, cs

# Ids, labels, severities and patterns are fixed values.
CONTENT_RULES: tuple[ContentRule, ...] = (
    ContentRule("profanity", "Profanity", "moderate",
                ci(r"\b(f+u+c+k\w*|sh[i1]t\w*|bitch|asshole|bastard|dick(head)?)\b")
                + cs(r"(חרא|מניאק|בן ?זונה|זונה|תזדיין|מזדיין|שמוק|מטומטם|אידיוט|מפגר|דביל|טמבל)")),
    ContentRule("sexual", "Sexual / explicit", "high",
                ci(r"\b(porn(ography)?|xxx|nudes?|sex ?tape|explicit sexual|nsfw|onlyfans|sexting|send nudes|dick ?pic)\b")
                + cs(r"(פורנו|פורנוגרפ|תמונות עירום|עירום מלא|סקס|זיון|אורגזמה|חשפנ|סקסטינג)")),
    ContentRule("violence", "Violence / weapons", "high",
                ci(r"\b(behead|massacre|mutilate|how to (kill|murder)|(make|build) a bomb|school shooting)\b")
                + cs(r"(לרצוח|רצח|לפוצץ|פצצה|אקדח|רובה|לדקור|טבח|פיגוע|חומר נפץ|ירי בבית ספר)")),
    ContentRule("self-harm", "Self-harm", "high",
                ci(r"\b(suicide|kill myself|self[- ]harm|end my life|how to die)\b")
                + cs(r"(להתאבד|התאבדות|לפגוע בעצמי|פגיעה עצמית|לשים קץ לחיי|איך למות|רוצה למות|אובדני)")),
    ContentRule("hate", "Hate / extremism", "high",
                ci(r"\b(ethnic cleansing|genocide|hate speech|white supremacy)\b")
                + cs(r"(טיהור אתני|רצח עם|שיח שנאה|עליונות לבנה|גזענות|נאצי|אנטישמיות)")),
    ContentRule("drugs", "Drugs / alcohol / vaping", "moderate",
                ci(r"\b(cocaine|heroin|meth(amphetamine)?|how to (make|cook) (drugs|meth)|buy drugs|vap(e|ing)|juul|e-?cig(arette)?|nicotine|get drunk|buy (alcohol|weed|vape)|fake id)\b")
                + cs(r"(סמים|קוקאין|הרואין|קנאביס|מריחואנה|אקסטזי|לקנות סמים|איך להכין סמים|קריסטל|אלכוהול|להשתכר|וייפ|סיגריה אלקטרונית|ניקוטין|לקנות אלכוהול)")),
    ContentRule("eating-disorder", "Eating disorders", "high",
                ci(r"\b(pro[- ]?ana|pro[- ]?mia|thinspo|thinspiration|how to purge|make myself throw up|starv(e|ing) myself|stop eating to lose|laxative diet)\b")
                + cs(r"(אנורקסיה|בולימיה|להקיא את האוכל|להרעיב את עצמי|הפרעת אכילה|לרזות מהר|פרו אנה)")),
    ContentRule("harassment", "Bullying / harassment", "high",
                ci(r"\b(kill yourself|kys|go die|nobody likes you|everyone hates you|you('re| are) (worthless|a loser|ugly|pathetic))\b")
                + cs(r"(לך תמות|תהרוג את עצמך|אף אחד לא אוהב אותך|כולם שונאים אותך|את מכוערת|אתה מכוער|לוזר|חתיכת כושל)")),
    ContentRule("grooming", "Grooming / predatory", "high",
                ci(r"\b(don'?t tell your (parents|mom|dad)|our (little )?secret|send me a (pic|photo|nude)|are you (home )?alone|how old are you really|let'?s meet (up|in person)|what are you wearing)\b")
                + cs(r"(אל תספר להורים|זה הסוד שלנו|שלח לי תמונה שלך|אתה לבד בבית|בת כמה את באמת|בוא ניפגש לבד|מה את לובשת)")),
)
