"""Curated corrections and the known wiki templates.

All entries are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Pages (name, heading) that describe a genre a second time.
IGNORED_PAGES = [
    ("Outline of jazz", None),
    ("History of disco", None),
    ("Styles of pop music", "Pop soul / Motown"),
    ("Styles of pop music", "Street pop"),
    ("List of industrial music genres", "Post-Industrial"),
]

# Fixed values: (page, label, time the article itself was corrected or null).
GENRE_RENAMES = [
    ("Popcorn (Romanian music style)", "Romanian popcorn", "2025-04-26T20:32:00Z"),
    ("Brega pop", "Brega-pop", None),
    ("Popcorn (Belgian music style)", "Belgian popcorn", None),
]

ARTIST_RENAMES: list[tuple] = []

# Derivative edges found wrong (source label > target label).
REJECTED_EDGES = """
Acoustic music > Honky-tonk
Americana > Rhythm and blues
Americana > Rock and roll
Chillstep > Chillwave
C-pop > Rhythm and blues
Ethiopian hip hop music > Funk
Ethiopian hip hop music > Jazz
Ethiopian hip hop music > Soul
LGBTQ music > Disco
LGBTQ music > Glam rock
LGBTQ music > House music
LGBTQ music > Hyperpop
Louisiana Creole and Cajun music > Hip-hop
Maskandi > Kwaito
Narcocorrido > Country music
Scottish hip -hop > Trip hop
"""

# Derivative edges that look odd and were found right.
ACCEPTED_EDGES = """
African blues > Rhythm and blues
African blues > Rock and roll
African blues > Swing
Appalachian music > Country music
Art pop > New wave
Art pop > Post-punk
Art pop > Synth-pop
Avant-funk > House music
Bahamian Rhyming Spiritual > Gospel music
Biker metal > Extreme metal
Biker metal > Hardcore punk
Black gospel music > Funk
Boogie > House music
Boogie-woogie > Rhythm and blues
Boogie-woogie > Rock and roll
British rhythm and blues > Psychedelic rock
British rock and roll > Beat
British rock and roll > Blues rock
Freakbeat > Psychedelic rock
Freakbeat > Punk rock
Western swing > Rock and roll
Bubblegum > Punk rock
Cadence rampa > Zouk
Cajun music > Country music
Cakewalk > Ragtime
College rock > Alternative rock
College rock > Indie rock
Creole music of Louisiana > Country music
Danger music > Noise music
Darkcore > Drum and bass
Deep funk > Hip-hop
Doo-wop > Soul
Dub > Hip-hop
Dunedin sound > Indie rock
Duranguense > Mexican pop
Electric blues > Rock and roll
Electric blues > Rock
Eurodisco > House music
Eurodisco > Techno
Folk jazz > New-age
Funk rock > New wave
Glam punk > New wave
Glam punk > Punk rock
Gwo ka > Zouk
Instrumental rock > Garage rock
Italo disco > Techno
Jump blues > Rhythm and blues
Jump blues > Rock and roll
Light music > Ambient music
Louisiana Creole and Cajun music > Country music
Louisiana Creole and Cajun music > Rhythm and blues
Louisiana Creole and Cajun music > Rock and roll
Mambo > Funk
Memphis soul > Funk
Mento > Reggae
Mento > Ska
New Mexico music > Country music
New musick > Post-punk
New Orleans rhythm and blues > Ska
New Orleans soul > Funk
Occult rock > Heavy metal
Old-time music > Country music
Orchestral Jazz > Swing
Philadelphia soul > Disco
Political hip hop > Gangsta rap
Preaching Chords > Gospel music
Proto-punk > Punk rock
Psychedelic soul > Disco
Pub rock > Punk rock
Raga rock > Psychedelic rock
Ragtime > Jazz
Red dirt > Country music
Reggae en Español > Reggaeton
Rocksteady > Reggae
Roots reggae > Dub
Smooth soul > Contemporary R&B
Snap music > Trap music
Son huasteco > Mexican pop
Son jarocho > Mexican pop
Southern gospel > Country music
Spiritual > Blues
Spiritual > Jazz
Spiritual > Rhythm and blues
Surf music > Punk rock
Surf rock > Punk rock
Symphonic mugham > World music
Tejano music > Country music
Traditional Black gospel > Rhythm and blues
Traditional Black gospel > Soul
Traditional pop > Pop music
Western music > Country music
"""

# Templates that show nothing.
HIDDEN_TEMPLATES = """
anchor authority_control cbignore certification_cite_ref chabad_(rebbes_and_chasidim)
cite_web clear commons disputed efn_portuguese_name external_media family_name_footnote
greece-singer-stub igbo_topics inflation multiple_image music_genre_stub
music_of_cape_verde nastaliq notetag out_of_date pronunciation psychedelic_sidebar r
ref_label reference_page refn rp sfn #tag:ref rembetika rock-band-stub
short_description sources_exist toc_limit use_dmy_dates webarchive wikibooks
culture_of_colombia culture_of_south_africa
"""

# Templates that stand for a fixed text.
FIXED_TEMPLATES = {
    "'": "’",
    "\"'": "‘“",
    "'\"": "’”",
    "'s": "’s",
    "`": "‘",
    "'_\"": "’”",
    '-"': "”",
    "aka": "a.k.a.",
    "circa": "c.",
    "em_dash": "—",
    "en_dash": "–",
    "*": " • ",
    "hair_space": " ",
    "lrm": "‎",
    "nbsp": " ",
    "né": "né",
    "nee": "née",
    "née": "née",
    "okina": "ʻ",
    "shy": "­",
    "sic": "[sic]",
    "singular": "sg.",
    "spaced_en_dash": " – ",
    "spaced_en_dash_space": " – ",
    "inflation/year": "year not available",
    "translation": "transl.",
}

# Templates shown as a bracketed label.
BRACKET_TEMPLATES = {
    "ai-retrieved_source": "AI-retrieved source",
    "according_to_whom": "according to whom?",
    "better_source": "better source",
    "broken_anchor": "broken anchor",
    "by_whom": "by whom?",
    "citation_needed": "citation needed",
    "citation_needed_lead": "not verified in body",
    "clarify": "clarification needed",
    "clarify_span": "clarify",
    "contradiction-inline": "contradiction",
    "dead_link": "dead link",
    "deprecated_source": "deprecated source?",
    "disambiguation_needed": "disambiguation needed",
    "discuss": "discuss",
    "disputed_inline": "disputed",
    "dubious": "dubious",
    "excessive_citations_inline": "excessive citations",
    "failed_verification": "failed verification",
    "full_citation_needed": "full citation needed",
    "irrelevant_citation": "irrelevant citation",
    "new_archival_link_needed": "new archival link needed",
    "original_research_inline": "original research?",
    "page_needed": "page needed",
    "peacock_inline": "peacock prose",
    "primary_source_inline": "non-primary source needed",
    "pronunciation_needed": "pronunciation?",
    "relevance_inline": "relevance?",
    "self-published_inline": "self-published source?",
    "source": "citation needed",
    "technical_inline": "jargon",
    "text-source_inline": "text–source integrity?",
    "update_inline": "needs update",
    "unreliable_source": "unreliable source?",
    "verification_needed": "verification needed",
    "what": "what?",
    "when": "when?",
    "which": "which?",
    "where": "where?",
    "who": "who?",
}


# Templates with a text or layout of their own.
COMPONENT_TEMPLATES = """
currentyear currentmonthname single+space space+double two_pixel_space abbr abbrlink age
audio as_of birth_date birth_based_on_age_as_of_date birth_based_on_age_at_death bracket
quote convert css-style cyrl date2 efn em esccnty escyr etymology frac gloss height hlist
iast iast3 india_rs interlanguage_link ipa ipa-all ipac-en korean korean/auto lang
lang-ka lang-rus lang-sh-cyrl lang-sr-cyr lang-sr-cyrl-latn lang-su-fonts langx
language_with_name/for linktext listen lit mongolunicode music nihongo nihongo2 nihongo3
nihongo4 not_a_typo nobold noitalic nowrap numero ₱ post_nominals respelling rtgs ruby
sans-serif script script/hebrew small start_date spaces sup thin_space transliteration
url us$ usd uss wikt-lang lang-zh time_ago
"""

# Other names of templates.
TEMPLATE_ALIASES = """
clear_left > clear
clear_right > clear
culture_of_peru > culture_of_colombia
music-genre-stub > music_genre_stub
music_of_jamaica > music_of_cape_verde
script/nastaliq > nastaliq
nq > nastaliq
ref label > ref_label
toclimit > toc_limit
use_indian_english > use_dmy_dates
sfnp > sfn
snf > sfn
also_known_as > aka
a.k.a. > aka
c. > circa
emdash > em_dash
mdash > em_dash
-- > em_dash
endash > en_dash
ndash > en_dash
ne > né
hairsp > hair_space
snd > spaced_en_dash
spaced_ndash > spaced_en_dash
spnd > spaced_en_dash
snds > spaced_en_dash_space
px2 > two_pixel_space
'- > single+space
according_to_whom? > according_to_whom
better_source_needed > better_source
by_whom? > by_whom
cn > citation_needed
cita_requerida > citation_needed
citesource > citation_needed
fact > citation_needed
facts > citation_needed
reference_needed > citation_needed
source_needed > citation_needed
source? > source
citation_needed_(lead) > citation_needed_lead
not_verified_in_body > citation_needed_lead
clarification_needed > clarify
clarification_needed_span > clarify_span
contradictory_inline > contradiction-inline
dn > disambiguation_needed
excessive_citations > excessive_citations_inline
not_in_ref > failed_verification
notinref > failed_verification
verification_failed > failed_verification
pn > page_needed
pronunciation? > pronunciation_needed
pron > pronunciation_needed
sps > self-published_inline
unreliable_source? > unreliable_source
unreliable_source_inline > unreliable_source
what? > what
when? > when
which? > which
where? > where
who? > who
asof > as_of
blockquote > quote
cquote > quote
efn-ua > efn
ety > etymology
ill > interlanguage_link
interlanguage_link_multi > interlanguage_link
ipa-cen > ipac-en
ko-hhrm > korean
lang-latn > lang
langnf > language_with_name/for
langr > lang
lang_unset_italics > lang
sund > lang-su-fonts
lang-sr-cyrl > lang-sr-cyr
lit. > lit
literal > lit
literally > lit
literal_translation > lit
notatypo > not_a_typo
proper_name > not_a_typo
nobr > nowrap
post-nominal_styles > post_nominals
post-nominal > post_nominals
post-nominals > post_nominals
postnom > post_nominals
postnominal > post_nominals
postnominals > post_nominals
respell > respelling
smaller > small
thinspace > thin_space
thinsp > thin_space
tlit > transliteration
translit > transliteration
transl > transliteration
xlit > transliteration
us_dollar > us$
wt > wikt-lang
zh > lang-zh
timeago > time_ago
phillippine_peso > ₱
indian_rupee > india_rs
indian_rupee_symbol > india_rs
indian_rupees > india_rs
inr > india_rs
₹ > india_rs
"""


def _edges(spark: SparkSession, listing: str) -> DataFrame:
    rows = [tuple(line.split(" > ")) for line in listing.strip().splitlines()]
    labels = spark.createDataFrame(rows, "src_label string, dst_label string")
    return labels.withColumn("ty", F.lit(0).cast("tinyint"))


def _renames(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    table = spark.createDataFrame(rows, "page string, new_label string, fixed_at string")
    return table.withColumn("fixed_at", F.to_timestamp("fixed_at"))


def curation_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Curated tables by name; all of fixed, small size."""
    return {
        "ignored_pages": spark.createDataFrame(IGNORED_PAGES, "name string, heading string"),
        "genre_renames": _renames(spark, GENRE_RENAMES),
        "artist_renames": _renames(spark, ARTIST_RENAMES),
        "rejected_edges": _edges(spark, REJECTED_EDGES),
        "accepted_edges": _edges(spark, ACCEPTED_EDGES),
    }


def template_dim(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """``(name, canonical, kind, text)`` of the known templates.

    ``kind`` is ``hidden``, ``fixed``, ``bracket`` or, for templates with a
    layout of their own, ``component``.  Other names of a template have its
    kind and text.  ``more(name, canonical, kind, text)`` adds the caller's;
    the built-in row stays where both have a name.
    """
    rows = [(name, name, "hidden", None) for name in HIDDEN_TEMPLATES.split()]
    rows += [(name, name, "fixed", shown) for name, shown in FIXED_TEMPLATES.items()]
    rows += [(name, name, "bracket", f"[{shown}]") for name, shown in BRACKET_TEMPLATES.items()]
    rows += [(name, name, "component", None) for name in COMPONENT_TEMPLATES.split()]
    of = {row[0]: row for row in rows}
    other = [line.split(" > ") for line in TEMPLATE_ALIASES.strip().splitlines()]
    rows += [(name, *of[canonical][1:]) for name, canonical in other]
    known = spark.createDataFrame(rows, "name string, canonical string, kind string, text string")
    return known if more is None else known.unionByName(more.join(known, "name", "left_anti"))
