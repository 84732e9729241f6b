"""Reserved words per language.

Fixed values: a name found here is never renamed and never used as a substitute.
Python keywords come from the standard library's own list.
"""

from __future__ import annotations

import keyword

from pyspark.sql import DataFrame, SparkSession

C_KEYWORDS = """
auto break case char const continue default do double else enum extern float for goto if inline int long
register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while
_Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local __func__
""".split()

C_MACROS = """
NULL _IOFBF _IOLBF BUFSIZ EOF FOPEN_MAX TMP_MAX FILENAME_MAX L_tmpnam SEEK_CUR SEEK_END SEEK_SET
EXIT_FAILURE EXIT_SUCCESS RAND_MAX MB_CUR_MAX
""".split()

# Names that the C and C++ standard headers declare, by header.
C_SPECIAL_IDS = """
main
stdio cstdio stdio.h size_t FILE fpos_t stdin stdout stderr
remove rename tmpfile tmpnam fclose fflush fopen freopen setbuf setvbuf fprintf fscanf printf scanf snprintf
sprintf sscanf vprintf vscanf vsnprintf vsprintf vsscanf fgetc fgets fputc getc getchar putc putchar puts ungetc
fread fwrite fgetpos fseek fsetpos ftell rewind clearerr feof ferror perror getline
stdlib cstdlib stdlib.h div_t ldiv_t lldiv_t
atof atoi atol atoll strtod strtof strtold strtol strtoll strtoul strtoull rand srand aligned_alloc calloc malloc
realloc free abort atexit exit at_quick_exit _Exit getenv quick_exit system bsearch qsort abs labs llabs div ldiv
lldiv mblen mbtowc wctomb mbstowcs wcstombs
string cstring string.h
memcpy memmove memchr memcmp memset strcat strncat strchr strrchr strcmp strncmp strcoll strcpy strncpy strerror
strlen strspn strcspn strpbrk strstr strtok strxfrm memccpy mempcpy strcat_s strcpy_s strdup strerror_r strlcat
strlcpy strsignal strtok_r
iostream istream ostream fstream sstream iomanip iosfwd ios wios streamoff streampos wstreampos streamsize cout
cerr clog cin boolalpha noboolalpha skipws noskipws showbase noshowbase showpoint noshowpoint showpos noshowpos
unitbuf nounitbuf uppercase nouppercase left right internal dec oct hex fixed scientific hexfloat defaultfloat
width fill precision endl ends flush ws
sin cos tan asin acos atan atan2 sinh cosh tanh exp sqrt log log10 pow powf ceil floor fabs cabs frexp ldexp modf
fmod hypot poly matherr
""".split()

C_OPERATORS = """
... >>= <<= += -= *= /= %= &= ^= |= >> << ++ -- -> && || <= >= == != ; { <% } %> , : = ( ) [ <: ] :> . & ! ~ - +
* / % < > ^ | ?
""".split()

JAVA_KEYWORDS = """
abstract assert boolean break byte case catch do double else enum extends final finally float for goto if
implements import instanceof int interface long native new package private protected public return short static
strictfp super switch throws transient try void volatile while
""".split()

JAVA_SPECIAL_IDS = """
main args Math System Random Byte Short Integer Long Float Double Character Boolean Data ParseException
SimpleDateFormat Calendar Object String StringBuffer StringBuilder DateFormat Collection List Map Set Queue
ArrayList HashSet HashMap
""".split()

#: (language, kind) -> words. Only languages listed here have a name rule at all.
RESERVED = {
    ("c", "keyword"): C_KEYWORDS,
    ("c", "macro"): C_MACROS,
    ("c", "special"): C_SPECIAL_IDS,
    ("c", "operator"): C_OPERATORS,
    ("java", "keyword"): JAVA_KEYWORDS,
    ("java", "special"): JAVA_SPECIAL_IDS,
    ("python", "keyword"): list(keyword.kwlist),
}

LANGUAGES = ("java", "c", "python", "javascript")
NAME_RULE_LANGUAGES = ("java", "c", "python")


def reserved_words(lang: str, with_operators: bool = False) -> list[str]:
    """Words no name of ``lang`` may use."""
    return sorted(
        {w for (l, kind), words in RESERVED.items() if l == lang and (with_operators or kind != "operator") for w in words}
    )


def reserved_table(spark: SparkSession, extra: dict[tuple[str, str], list[str]] | None = None) -> DataFrame:
    """``reserved(lang, kind, word)``: a fixed dictionary of a few hundred rows, so broadcasting it is safe."""
    merged = {**RESERVED, **(extra or {})}
    rows = [(lang, kind, word) for (lang, kind), words in merged.items() for word in dict.fromkeys(words)]
    return spark.createDataFrame(rows, "lang string, kind string, word string")
