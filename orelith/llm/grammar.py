"""Lexers and adjacency tables for JavaScript, TypeScript and C#.

The adjacency table of a language is derived from its grammar below: a pair of token classes is permissible if some
production can put the one right after the other.
"""

from __future__ import annotations

import re
from functools import cache

# ---- fixed values: file extensions of each language
ELEMENT_EXTENSIONS = (".tsx", ".jsx")
LANGUAGE_OF = {".ts": "ts", ".tsx": "ts", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".cs": "cs"}
# ---- fixed values: reserved words; contextual words may also be names
JS_RESERVED = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
JS_CONTEXTUAL = set("as async await from get let of set static yield".split())
TS_CONTEXTUAL = JS_CONTEXTUAL | set("abstract any asserts declare implements infer interface is keyof module namespace never override private protected public readonly satisfies type unique accessor".split())
CS_RESERVED = set("abstract as base break case catch checked class const continue default delegate do else enum event explicit extern finally fixed for foreach goto if implicit in interface internal is lock namespace new operator out override params private protected public readonly ref return sealed sizeof stackalloc static struct switch this throw try typeof unchecked unsafe using virtual volatile while null true false".split())
CS_TYPES = set("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
CS_CONTEXTUAL = set("async await get set init add remove partial record var where when yield nameof global required file and or not with value from select let join on into orderby ascending descending equals by group".split())

_JS_PUNCT = sorted("{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @ #".split(), key=len, reverse=True)
_CS_PUNCT = sorted("{ } ( ) [ ] ; , < > <= >= == != + - * / % ++ -- << & | ^ ! ~ && || ?? ? ?. : :: = += -= *= /= %= <<= >>= &= |= ^= ??= => -> . ..".split(), key=len, reverse=True)
_JS_PUNCT_RE = re.compile("|".join(map(re.escape, _JS_PUNCT)))
_CS_PUNCT_RE = re.compile("|".join(map(re.escape, _CS_PUNCT)))
_SPACE = re.compile(r"[^\S\r\n]+")
_NAME = re.compile(r"(?:[^\W\d]|[$\\])(?:[\w$]|‌|‍)*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[nfFdDmMuUlL]*")
_STRING = {q: re.compile(q + r"(?:[^\\\n\r" + q + r"]|\\(?:\r\n|[\s\S]))*" + q) for q in "'\""}
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-zA-Z]*")
_DECORATOR = re.compile(r"@[^\W\d][\w$]*(?:\.[^\W\d][\w$]*)*")
_CHAR = re.compile(r"'(?:[^'\\\n\r]|\\[^\n\r][0-9a-fA-F]{0,8})'")
_LINE = re.compile(r"[^\r\n\u2028\u2029]*")
_CS_OPEN = re.compile(r'(?:\$@|@\$|@|\$+)"')
_KEYED = re.compile(r"\s*:(?!:)")
_ELEMENT = re.compile(r"<(?:\s*([A-Za-z_$][\w$.:-]*)(?=[\s/>{])(?!\s*,|\s+extends\b)|(?=>)())")
_CLOSE_TAG = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*|)\s*>")
_BLANKS = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*)*")
_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$.:-]*(\s*=\s*)?")
_VALUE = re.compile(r"\"[^\"]*\"|'[^']*'")
_TEXT = re.compile(r"[^<{}>]*")
_BEFORE_REGEX = set("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => && || ?? == != === !== += -= *= /= return typeof case in of do else void delete throw instanceof new await yield BOF".split())


def lex(text: str, lang: str, jsx: bool = False) -> tuple[list[str], list[bool], str]:
    """(token classes, whether a line break stands before each, '' or the lexical error).

    Classes: id, num, str, tpl, re, deco, jsx, the reserved or contextual word itself, or the punctuator. A byte-order mark at
    the start is skipped. With jsx, an element is one jsx token followed by its holes, each as tokens between round brackets.
    """
    out: list[str] = []
    breaks: list[bool] = []
    i = 0
    if text.startswith("\ufeff"):
        i = 1
    if lang != "cs" and text.startswith("#!", i):
        i = text.find("\n") if "\n" in text else len(text)
    _, error = _scan(text, i, lang, jsx, out, breaks, False)
    return out, breaks, error


def _scan(text: str, i: int, lang: str, jsx: bool, out: list[str], breaks: list[bool], hole: bool) -> tuple[int, str]:
    """Appends the tokens from i on, in a hole up to its closing bracket; (where it stopped, error)."""
    js = lang != "cs"
    reserved, contextual = (JS_RESERVED, TS_CONTEXTUAL if lang == "ts" else JS_CONTEXTUAL) if js else (CS_RESERVED, CS_CONTEXTUAL | CS_TYPES)
    punct = _JS_PUNCT_RE if js else _CS_PUNCT_RE
    n, fresh, depth = len(text), False, 0
    while i < n:
        c = text[i]
        if c in "\r\n\u2028\u2029":
            fresh = True
            i += 1
            continue
        if c == "\ufeff" or (c.isspace() and (m := _SPACE.match(text, i))):
            i = i + 1 if c == "\ufeff" else m.end()
            continue
        if c == "/" and text.startswith("//", i):
            i = _LINE.match(text, i).end()
            continue
        if c == "/" and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                return i, "comment without end"
            fresh = fresh or text.find("\n", i, end) >= 0
            i = end + 2
            continue
        if not js and c == "#" and (fresh or not out):
            i = _LINE.match(text, i).end()
            continue
        kind = None
        if not js and c in '$@' and (m := _CS_OPEN.match(text, i)):
            end = _cs_string(text, m)
            if end < 0:
                return i, "string without end"
            kind, i = "str", end
        elif not js and c == '"' and text.startswith('"""', i):
            end = text.find('"""', i + 3)
            if end < 0:
                return i, "string without end"
            kind, i = "str", end + 3
        elif c == '"' or (c == "'" and js):
            if not (m := _STRING[c].match(text, i)):
                return i, "string without end"
            kind, i = "str", m.end()
        elif c == "'":
            if not (m := _CHAR.match(text, i)):
                return i, "bad character literal"
            kind, i = "str", m.end()
        elif c == "`" and js:
            end = _template(text, i)
            if end < 0:
                return i, "template without end"
            kind, i = "tpl", end
        elif c.isdigit() or (c == "." and i + 1 < n and text[i + 1].isdigit()):
            m = _NUMBER.match(text, i)
            kind, i = "num", m.end()
            if _NAME.match(text, i):
                return i, "name right after a number"
        elif (m := _NAME.match(text, i)) or (not js and c == "@" and (m := _NAME.match(text, i + 1))):
            word = m.group()
            i = m.end()
            kind = "id"
            if (word in reserved or word in contextual) and c != "@":
                prior = out[-1] if out else "BOF"
                as_name = prior in (".", "?.") or (js and prior in ("{", ",") and _KEYED.match(text, i) is not None)
                kind = "id" if as_name else "type" if not js and word in CS_TYPES else word
        elif jsx and c == "<" and (out[-1] if out else "BOF") in _BEFORE_REGEX and _ELEMENT.match(text, i):
            out.append("jsx")
            breaks.append(fresh)
            fresh = False
            i, error = _element(text, i, lang, out, breaks)
            if error:
                return i, error
            continue
        elif c == "/" and js and (out[-1] if out else "BOF") in _BEFORE_REGEX and (m := _REGEX.match(text, i)):
            kind, i = "re", m.end()
        elif lang == "ts" and c == "@" and (m := _DECORATOR.match(text, i)):
            kind, i = "deco", m.end()
        elif m := punct.match(text, i):
            kind, i = m.group(), m.end()
            if hole:
                depth += (kind == "{") - (kind == "}")
                if depth < 0:
                    return i, ""
        else:
            return i, "no token of this language"
        out.append(kind)
        breaks.append(fresh)
        fresh = False
    return i, "element without end" if hole else ""


def _element(text: str, i: int, lang: str, out: list[str], breaks: list[bool]) -> tuple[int, str]:
    """Reads an element with all inside it from its < on; (its end, error)."""
    open_tags: list[str] = []

    def read_hole(i: int) -> tuple[int, str]:
        out.append("(")
        breaks.append(False)
        i, error = _scan(text, i, lang, True, out, breaks, True)
        out.append(")")
        breaks.append(False)
        return i, error

    while True:
        if text.startswith("</", i):
            m = _CLOSE_TAG.match(text, i)
            if not m or not open_tags or open_tags.pop() != m.group(1):
                return i, "elements that do not close in order"
            i = m.end()
        else:
            m = _ELEMENT.match(text, i)
            if not m:
                return i, "bad element"
            i = m.end()
            while True:  # attributes
                i = _BLANKS.match(text, i).end()
                if text.startswith("/>", i):
                    i += 2
                    break
                if text.startswith(">", i):
                    open_tags.append(m.group(1) or "")
                    i += 1
                    break
                if text.startswith("{", i):
                    i, error = read_hole(i + 1)
                    if error:
                        return i, error
                    continue
                a = _ATTRIBUTE.match(text, i)
                if not a:
                    return i, "bad element"
                i = a.end()
                if a.group(1) and text.startswith("{", i):
                    i, error = read_hole(i + 1)
                    if error:
                        return i, error
                elif a.group(1):
                    v = _VALUE.match(text, i)
                    if not v:
                        return i, "bad element"
                    i = v.end()
        while open_tags:  # children up to the next tag
            i = _TEXT.match(text, i).end()
            if not text.startswith("{", i):
                break
            i, error = read_hole(i + 1)
            if error:
                return i, error
        if not open_tags:
            return i, ""
        if i >= len(text) or text[i] != "<":
            return i, "bad element"


def _template(text: str, i: int) -> int:
    """End of the template literal that starts at i, -1 if it has none; substitutions may hold templates and strings."""
    i += 1
    n = len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i = _template(text, i)
                    if i < 0:
                        return -1
                    continue
                if c in "'\"" and (m := _STRING[c].match(text, i)):
                    i = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    return -1


def _cs_string(text: str, m: re.Match) -> int:
    """End of a verbatim or interpolated string; the holes of an interpolated one are skipped by counting braces."""
    verbatim, holes, i, n = "@" in m.group(), "$" in m.group(), m.end(), len(text)
    while i < n:
        c = text[i]
        if c == '"':
            if verbatim and text.startswith('""', i):
                i += 2
                continue
            return i + 1
        if c in "\r\n" and not verbatim:
            return -1
        if c == "\\" and not verbatim:
            i += 2
        elif holes and c == "{" and not text.startswith("{{", i):
            depth, i = 1, i + 1
            while i < n and depth:
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 2 if holes and text[i : i + 2] in ("{{", "}}") else 1
    return -1


# ---- grammars: one nonterminal a line, alternatives after |, X? optional, X* repeated; lower-case words and signs are
# ---- token classes, words with a capital are nonterminals
_JS = """
Program = BOF Item* EOF
Item = Stmt | Import ; | Export ; | ExportDecl
Import = import Clause from str With? | import str
With = with Object
Clause = id | id , Braces | id , * as id | Braces | * as id
Braces = { Names? }
Names = Alias | Alias , | Alias , Names
Alias = Word | Word as Word | str as Word
Word = id | default
Export = export Braces From? | export * From | export * as id From | export default Expr
From = from str
ExportDecl = export Declared | export default Declared | export default async? function *? ( Params? ) Returns? Block | export default Class
Declared = Func | ClassDecl | VarDecl ;
BareExport = export VarDecl
Stmt = Block | ; | Simple ; | if ( Expr ) Stmt Else? | for await? ( For ) Stmt | while ( Expr ) Stmt | switch ( Expr ) { Case* } | try Block Catch? Finally? | Func | ClassDecl | id : Stmt | do Stmt while ( Expr ) ;?
Else = else Stmt
For = ForHead? ; Expr? ; Expr? | ForVar of Expr | ForVar in Expr
ForHead = VarDecl | Expr
ForVar = VarWord Target | Expr
Case = case Expr : Stmt* | default : Stmt*
Catch = catch Block | catch ( Target ) Block
Finally = finally Block
Block = { Stmt* }
Simple = VarDecl | Expr | return | return Expr | throw Expr | break | break id | continue | continue id | debugger
VarDecl = VarWord Vars
VarWord = var | let | const
Vars = Var | Var , Vars
Var = Target | Target = Expr1
Target = id Typed? | { Props? } Typed? | [ Elems? ] Typed?
Func = async? function *? id Generic? ( Params? ) Returns? Block
Params = Param | Param , | Param , Params
Param = ParamTarget | ParamTarget = Expr1 | ... Target
ParamTarget = Target
ClassDecl = class id Generic? Heritage? ClassBody
Class = class id? Generic? Heritage? ClassBody
Heritage = extends Expr1
ClassBody = { Member* }
Member = ; | static? MemberHead | static Block | BareField ;
BareField = static? Field
MemberHead = async? *? Key Generic? ( Params? ) Returns? Block | Accessor Key ( Params? ) Returns? Block
Field = Key | Key = Expr1
Accessor = get | set
Key = Name | str | num | [ Expr1 ] | # id
Name = id
Expr = Expr1 | Expr1 , Expr
Expr1 = Unit | Unit Op Expr1 | Unit ? Expr1 : Expr1 | Arrow
Op = + | - | * | / | % | ** | << | >> | >>> | < | > | <= | >= | == | != | === | !== | & | ^ | BAR | && | BAR2 | ?? | in | instanceof | = | += | -= | *= | /= | %= | **= | <<= | >>= | >>>= | &= | ^= | BAR= | &&= | BAR2= | ??=
Unit = Prefix Unit | Primary Post* | new Unit
Prefix = ! | ~ | + | - | ++ | -- | typeof | void | delete | await | yield | yield *
Primary = id | num | str | tpl | re | jsx | this | super | null | true | false | ( Expr ) | [ Elems? ] | Object | async? function *? id? Generic? ( Params? ) Returns? Block | Class | import | # id
Post = . id | . # id | ?. id | ?. ( Args? ) | ?. [ Expr ] | [ Expr ] | ( Args? ) | tpl | ++ | --
Args = Arg | Arg , | Arg , Args
Arg = Expr1 | ... Expr1
Elems = Elem | Elem , Elems | , Elems | Elem , | ,
Elem = Expr1 | ... Expr1
Object = { Props? }
Props = Prop | Prop , | Prop , Props
Prop = Key : Expr1 | id | id = Expr1 | ... Expr1 | async? *? Key ( Params? ) Returns? Block | Accessor Key ( Params? ) Returns? Block
Arrow = async? Head => Expr1 | async? Head => Block
Head = id | ( Params? ) Returns?
Typed = NONE
Returns = NONE
Generic = NONE
"""
_TS = """
Typed = ? : Type | : Type | ! : Type
Returns = : Type | : asserts id | : asserts? id is Type
Generic = < TypeParams >
TypeParams = TypeParam | TypeParam , | TypeParam , TypeParams
TypeParam = const? in? id | id extends Type | id = Type | id extends Type = Type
Type = BAR? TypeUnit | TypeUnit BAR Type | TypeUnit & Type | TypeUnit extends Type ? Type : Type | new? Generic? ( Params? ) => Type
TypeUnit = TypePrim TypePost*
TypePrim = id TypeArgs? | void | null | this | true | false | str | num | - num | tpl | ( Type ) | TypeBody | [ TypeList? ] | typeof id | keyof TypeUnit | readonly TypeUnit | unique TypeUnit | infer id | import ( str )
TypePost = . id TypeArgs? | [ ] | [ Type ]
TypeArgs = < TypeList >
TypeList = TypeItem | TypeItem , | TypeItem , TypeList
TypeItem = Type | ... Type | id : Type | id ? : Type | ... id : Type | Type ?
TypeBody = { TypeMember* }
TypeMember = TypeMem ; | TypeMem ,
TypeMem = readonly? Key Typed | Key OptMark? Generic? ( Params? ) Returns? | readonly? [ id : Type ] Returns | readonly? [ id in Type ] OptMark? Returns | new? Generic? ( Params? ) Returns? | Accessor Key ( Params? ) Returns? | Key | Key ?
OptMark = ?
Stmt += declare? interface id Generic? IfaceHeritage? TypeBody | Bare ; | const? enum id { Enums? } | declare? Space Block | abstract ClassDecl | declare Declared | Decor+ ClassDecl
Bare = declare? type id Generic? = Type
Space = namespace id Dotted* | module id Dotted* | module str | namespace id
Dotted = . id
Enums = Enum | Enum , | Enum , Enums
Enum = Key | Key = Expr1
IfaceHeritage = extends TypeRefs
TypeRefs = Type | Type , TypeRefs
Heritage += extends Expr1 Implements | Implements | extends Expr1 TypeArgs Implements?  | extends Expr1 TypeArgs
Implements = implements TypeRefs
ExportDecl += export interface id Generic? IfaceHeritage? TypeBody | export Bare ; | export const? enum id { Enums? } | export abstract ClassDecl | export declare Declared | export Space Block | export type Braces From? | Decor+ export default? ClassDecl | export default interface id TypeBody | export = Expr ;
Import += import type Clause from str | import id = Expr
Member += Mods MemberHead | Sig ; | Decor+ MemberHead | Decor+ Mods MemberHead | Mods? [ id : Type ] Returns ;
BareField += Decor* Mods? Field
Sig = Mods? MethodSig
MethodSig = async? Key OptMark? Generic? ( Params? ) Returns?
MemberHead += async? *? Key OptMark Generic? ( Params? ) Returns? Block
Mods = Mod | Mod Mods
Mod = public | private | protected | readonly | static | abstract | override | declare | accessor
Field += Key Typed | Key Typed = Expr1 | Key ?
ParamTarget += Mods ParamTarget | Decor ParamTarget | this Typed
Decor = deco | deco ( Args? )
Op += as | satisfies
Unit += Unit as Type | Unit satisfies Type | Unit as const
Post += ! | TypeArgs ( Args? ) | TypeArgs
Prefix += TypeArgs
Arrow += async? Generic ( Params? ) Returns? => Expr1 | async? Generic ( Params? ) Returns? => Block
Func += async? function *? id Generic? ( Params? ) Returns? ;
Vars += Target Typed
"""
_CS = """
Unit0 = BOF Using* Top* EOF
Using = global? using static? QName ; | global? using id = Type ;
QName = id | QName . id | id :: id | global :: QName | QName < TypeArgs? >
Top = Attrs? Mods? TypeDecl | namespace QName { Using* Top* } ;? | namespace QName ; | Stmt | Attrs
Attrs = [ AttrList ] | [ AttrList ] Attrs
AttrList = Attr | Attr , | Attr , AttrList
Attr = QName | QName ( Args? ) | id : QName | id : QName ( Args? ) | return : QName
Mods = Mod | Mod Mods
Mod = public | private | protected | internal | static | abstract | sealed | virtual | override | readonly | partial | async | const | new | extern | unsafe | volatile | required | file | ref | fixed | event | implicit | explicit
TypeDecl = Kind id TypeParams? Primary? Bases? Where* Body ;? | Kind id TypeParams? Primary? Bases? Where* ; | enum id Bases? { Enums? } ;? | delegate Type id TypeParams? ( Params? ) Where* ;
Kind = class | struct | interface | record | record class | record struct | ref struct
Primary = ( Params? )
TypeParams = < TypeParamList >
TypeParamList = TypeParam | TypeParam , TypeParamList
TypeParam = id | in id | out id
Bases = : BaseList
BaseList = Type | Type , BaseList | Type ( Args? ) | Type ( Args? ) , BaseList
Where = where id : Constraints
Constraints = Constraint | Constraint , Constraints
Constraint = Type | class | struct | new ( ) | class ?
Enums = Enum | Enum , | Enum , Enums
Enum = Attrs? id | Attrs? id = Expr
Body = { Member* }
Member = Attrs? Mods? MemberBody | Attrs? Mods? TypeDecl
MemberBody = Type QName TypeParams? ( Params? ) Where* Tail | Type QName Prop | Type Decls ; | id ( Params? ) Init? Tail | ~ id ( ) Tail | Type operator AnyOp ( Params? ) Tail | operator Type ( Params? ) Tail | Type this [ Params ] Prop | ;
Init = : base ( Args? ) | : this ( Args? )
Tail = Block | => Expr ; | ;
Prop = { Access+ } | { Access+ } = Expr ; | => Expr ;
Access = Attrs? Mods? AccessWord Tail
AccessWord = get | set | init | add | remove
AnyOp = + | - | * | / | % | == | != | < | > | <= | >= | ! | ~ | ++ | -- | & | BAR | ^ | << | true | false
Params = Param | Param , Params
Param = Attrs? ParamMod* Type id | Attrs? ParamMod* Type id = Expr | id
ParamMod = ref | out | in | this | params | scoped
Type = TypeName TypePost*
TypeName = QName | type | var | QName TypeArgList | ( TupleTypes )
TypeArgList = < TypeArgs >
TypeArgs = Type | Type , TypeArgs | , | , TypeArgs
TypePost = ? | [ ] | [ Commas ] | * | . id | . id TypeArgList
Commas = , | , Commas
TupleTypes = Type id? | Type id? , TupleTypes
Block = { Stmt* }
Stmt = Block | ; | Expr ; | Mods? Type Decls ; | if ( Expr ) Stmt | else Stmt | for ( ForInit? ; Expr? ; Exprs? ) Stmt | await? foreach ( Type id in Expr ) Stmt | foreach ( var ( Decls2 ) in Expr ) Stmt | while ( Expr ) Stmt | do Stmt while ( Expr ) ; | switch ( Expr ) { Section* } | try Block Catch* Finally? | return ; | return Expr ; | throw ; | throw Expr ; | break ; | continue ; | goto id ; | goto case Expr ; | goto default ; | await? using ( Resource ) Stmt | await? using Type Decls ; | lock ( Expr ) Stmt | yield return Expr ; | yield break ; | id : Stmt | checked Block | unchecked Block | unsafe Block | fixed ( Resource ) Stmt | Attrs? Mods? Type QName TypeParams? ( Params? ) Where* Tail
Decls2 = id | id , Decls2
Decls = Decl | Decl , Decls
Decl = id | id = Expr | id [ Expr ]
ForInit = Type Decls | Exprs
Resource = Type Decls | Expr
Exprs = Expr | Expr , Exprs
Section = Label Stmt*
Label = case Expr : | case Expr when Expr : | default :
Catch = catch Block | catch ( Type id? ) Filter? Block
Filter = when ( Expr )
Finally = finally Block
Expr = Unit | Unit Op Expr | Unit ? Expr : Expr | Lambda | Unit is Pattern | Unit is not Pattern | Unit as Type | Unit switch { Arms } | Unit with { Fields? } | throw Expr | ref Expr | Query
Op = + | - | * | / | % | << | > > | < | > | <= | >= | == | != | & | ^ | BAR | && | BAR2 | ?? | = | += | -= | *= | /= | %= | <<= | >>= | &= | BAR= | ^= | ??= | .. | and | or
Pattern = Type | Type id | null | num | str | not Pattern | Rel Unit | Pattern and Pattern | Pattern or Pattern | Type? { Props2? } id? | var id | ( Exprs ) | - num | true | false
Rel = < | > | <= | >=
Props2 = id : Pattern | id : Pattern , | id : Pattern , Props2
Arms = Arm | Arm , | Arm , Arms
Arm = Pattern => Expr | Pattern when Expr => Expr
Unit = Prefix Unit | Prim Post* | ( Type ) Unit
Prefix = ! | ~ | + | - | ++ | -- | await | & | * | ^
Prim = id | num | str | this | base | null | true | false | type | ( Exprs ) | ( Named ) | New | typeof ( Type ) | sizeof ( Type ) | nameof ( Expr ) | default | default ( Type ) | checked ( Expr ) | unchecked ( Expr ) | delegate Block | delegate ( Params? ) Block | stackalloc Type | id TypeArgList | global :: id | [ Exprs? ] | id :: id
Named = id : Expr | id : Expr , Named
New = new Type ( Args? ) Init2? | new Type Init2 | new ( Args? ) Init2? | new [ ] Init2 | new Type [ Exprs ] Init2? | new Init2
Init2 = { Fields? }
Fields = Field | Field , | Field , Fields
Field = Expr | id = Expr | id = Init2 | [ Expr ] = Expr | Init2
Post = . id | . id TypeArgList | ?. id | ? [ Exprs ] | [ Exprs ] | ( Args? ) | ++ | -- | ! | -> id | ?. id TypeArgList
Args = Arg | Arg , Args
Arg = Expr | id : Expr | ref Expr | out Expr | out Type id | in Expr | id : out Type id
Lambda = LambdaHead => Expr | LambdaHead => Block
LambdaHead = async? id | async? ( Params? ) | static LambdaHead
Query = from id in Expr QueryPart* select Expr | from Type id in Expr QueryPart* select Expr
QueryPart = where Expr | let id = Expr | orderby Exprs | orderby Exprs descending | from id in Expr | join id in Expr on Expr equals Expr | group Expr by Expr | into id
Member += Stmt0
Stmt0 = Attrs? Mods? Type Decls = Init2 ; | Attrs? Mods? Type id = Init2 ;
Decl += id = Init2
"""


def _rules(*texts: str) -> dict[str, list[list[str]]]:
    rules: dict[str, list[list[str]]] = {}
    for text in texts:
        for line in filter(None, map(str.strip, text.splitlines())):
            name, _, body = line.partition(" = ") if " += " not in line.split(" = ")[0] else line.partition(" += ")
            more = " += " in line and line.index(" += ") == len(name)
            alts = [a.split() for a in body.split(" | ")]
            rules[name.strip()] = (rules.get(name.strip(), []) + alts) if more else alts
    return rules


@cache
def pairs(lang: str) -> tuple[frozenset[tuple[str, str]], frozenset[tuple[str, str]]]:
    """(pairs permissible anywhere, pairs permissible across a line break only)."""
    rules = _rules(_CS) if lang == "cs" else _rules(_JS) if lang == "js" else _rules(_JS, _TS)
    names = set(rules)
    flat: dict[str, list[list[str]]] = {k: [] for k in rules}

    def base(sym: str) -> tuple[str, str]:
        if sym in ("**", "??"):
            return sym, ""
        for mark in "?*+":
            if len(sym) > 1 and sym.endswith(mark) and sym[:-1] in names | {"async", "const", "in", "readonly", "new", "declare", "asserts", "default", "await", "static", ";", "id", "*", "function", "global", "out"}:
                return sym[:-1], mark
        return sym, ""

    plain = {"BAR": "|", "BAR2": "||", "BAR=": "|=", "BAR2=": "||="}
    for name, alts in rules.items():
        for alt in alts:
            if alt == ["NONE"]:
                continue
            flat[name].append([*alt])
    nullable: set[str] = set()
    first: dict[str, set[str]] = {k: set() for k in rules}
    last: dict[str, set[str]] = {k: set() for k in rules}
    follow: set[tuple[str, str]] = set()

    def opt(sym: str) -> bool:
        b, mark = base(sym)
        return mark in ("?", "*") or b in nullable

    def ends(sym: str, table: dict[str, set[str]]) -> set[str]:
        b, _ = base(sym)
        return table[b] if b in names else {plain.get(b, b)}

    empty = {k for k, v in rules.items() if v == [["NONE"]]}
    nullable |= empty
    changed = True
    while changed:
        before = (len(nullable), sum(map(len, first.values())), sum(map(len, last.values())))
        for name, alts in flat.items():
            for alt in alts:
                if all(opt(s) for s in alt):
                    nullable.add(name)
                for order, table in ((alt, first), (alt[::-1], last)):
                    for s in order:
                        table[name] |= ends(s, table)
                        if not opt(s):
                            break
        changed = before != (len(nullable), sum(map(len, first.values())), sum(map(len, last.values())))
    for alts in flat.values():
        for alt in alts:
            for i, s in enumerate(alt):
                if base(s)[1] in ("*", "+"):
                    follow |= {(a, b) for a in ends(s, last) for b in ends(s, first)}
                for t in alt[i + 1 :]:
                    follow |= {(a, b) for a in ends(s, last) for b in ends(t, first)}
                    if not opt(t):
                        break
    contextual = {"js": JS_CONTEXTUAL, "ts": TS_CONTEXTUAL, "cs": CS_CONTEXTUAL}[lang]
    newline: set[tuple[str, str]] = set()
    if lang != "cs":
        begin = first["Item"] | {"}", "EOF"}
        bare = ["Simple", "Import", "Export", "BareExport", *(["Bare"] if lang == "ts" else [])]
        members = ["BareField", *(["Sig", "TypeMem"] if lang == "ts" else [])]
        newline |= {(a, b) for s in bare for a in last[s] for b in begin}
        newline |= {(a, b) for s in members for a in last[s] for t in ("Member", *members) for b in first[t]}
        # a block may close, and a file end, without the last semicolon
        follow |= {(a, b) for s in bare + members for a in last[s] for b in ("}", "EOF")}

    def loosen(ps: set[tuple[str, str]]) -> frozenset[tuple[str, str]]:
        # a contextual word may stand wherever a name may
        return frozenset(ps | {(w, b) for a, b in ps if a == "id" for w in contextual} | {(a, w) for a, b in ps if b == "id" for w in contextual} | {(v, w) for a, b in ps if (a, b) == ("id", "id") for v in contextual for w in contextual})

    return loosen(follow), loosen(newline)
