"""Instruction-override and prompt-reveal phrases in languages other than English."""

from __future__ import annotations

from glasswatch.rules.model import ci, cs

# The phrase patterns decide which texts are findings.
OVERRIDE_PHRASES = (
    *ci(r"ignora\s+(las\s+)?(instrucciones|indicaciones)\s+(anteriores|previas)"),          # es
    *ci(r"ignore[rz]?\s+(les\s+)?(instructions|consignes)\s+(précédentes|antérieures)"),     # fr
    *ci(r"ignoriere\s+(die\s+)?(vorherigen|vorigen|obigen)\s+(anweisungen|anordnungen)"),    # de
    *ci(r"ignora\s+(le\s+)?istruzioni\s+(precedenti|sopra)"),                                # it
    *ci(r"ignore\s+(as\s+)?instruções\s+(anteriores|prévias)"),                              # pt
    *ci(r"negeer\s+(de\s+)?(vorige|bovenstaande)\s+(instructies|aanwijzingen)"),             # nl
    *ci(r"игнорир[а-яё]*\s+(предыдущие|все|вышеуказанные)\s+(инструкц|указани)[а-яё]*"),     # ru
    *ci(r"ігнор[а-яіїєґ]*\s+(попередні|усі)\s+(інструкці|вказівк)[а-яіїєґ]*"),               # uk
    *ci(r"zignoruj\s+(poprzednie|wcześniejsze)\s+(instrukcje|polecenia)"),                   # pl
    *ci(r"önceki\s+(tüm\s+)?(talimatları|komutları)\s+(yoksay|görmezden\s+gel)"),            # tr
    *cs(r"تجاهل\s+(كل\s+)?(التعليمات|الأوامر)\s+السابقة"),                                   # ar
    *cs(r"دستور(ات|های)?\s+قبلی\s+را\s+نادیده\s+بگیر"),                                      # fa
    *cs(r"(पिछले|पूर्व)\s+निर्देश[^\s]{0,4}\s*(को\s*)?(अनदेखा|नज़रअंदाज़)"),                    # hi
    *cs(r"忽略(之前|上面|以上|先前)的?(指令|指示|说明|提示)"),                                # zh
    *cs(r"(以前|前|上記|これまで)の(指示|指令|命令)を?\s*無視"),                              # ja
    *cs(r"(이전|위의|앞의)\s*(지시|명령|지침)(을|를)?\s*무시"),                               # ko
    *ci(r"(bỏ\s+qua|phớt\s+lờ)\s+(các\s+)?hướng\s+dẫn\s+(trước|phía\s+trên)"),               # vi
    *ci(r"abaikan\s+(instruksi|arahan)\s+(sebelumnya|di\s+atas)"),                           # id, ms
    *cs(r"(เพิกเฉย|ละเว้น|เพิกเฉยต่อ)\s*คำสั่ง(ก่อนหน้า|ด้านบน)"),                            # th
    *ci(r"αγνόησε\s+(τις\s+)?(προηγούμενες|παραπάνω)\s+(οδηγίες|εντολές)"),                  # el
    *ci(r"ignor[ăa]\s+(instrucțiunile|comenzile)\s+(anterioare|precedente|de\s+mai\s+sus)"),  # ro
    *ci(r"ignoruj\s+(předchozí|výše\s+uvedené)\s+(pokyny|instrukce)"),                       # cs
    *ci(r"ignorera\s+(tidigare|föregående|ovanstående)\s+(instruktioner|anvisningar)"),      # sv
    *ci(r"ignor(er|ér)\s+(tidligere|forrige|ovenstående)\s+(instruksjoner|instruktioner)"),  # no, da
    *ci(r"(jätä\s+huomiotta|ohita)\s+(aiemmat|edelliset|yllä\s+olevat)\s+ohjeet"),           # fi
    *ci(r"hagyd\s+figyelmen\s+kívül\s+(az\s+)?(előző|fenti)\s+utasításokat"),                # hu
)

# Fixed values.
REVEAL_PHRASES = (
    *ci(r"(muestra|revela)\s+(tu\s+)?(prompt\s+del\s+sistema|instrucciones\s+del\s+sistema)"),  # es
    *ci(r"(montre|révèle)\s+(ton\s+)?(prompt|invite)\s+système"),                            # fr
    *ci(r"(zeige|verrate)\s+(deinen\s+)?system[-\s]?prompt"),                                # de
    *cs(r"(显示|展示|透露)(你的)?(系统提示|系统指令|系统提示词)"),                            # zh
    *cs(r"システム\s*プロンプト(を)?\s*(表示|教えて|見せて)"),                                # ja
)
