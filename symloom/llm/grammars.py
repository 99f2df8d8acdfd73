"""Grammars by language. `'x'` is a token, a lower-case name a class of tokens, `<Kind>` a bracketed group whose
content is a Kind; a choice `/` takes the first alternative that matches.

They take a superset of each language where telling apart would need names or types, never less.
"""

from __future__ import annotations

from functools import cache

from symloom.llm.peg import Bracket, Grammar

# Expressions in which a value may be followed by calls, indexes and members; a language adds its own Pre, Prim, Post.
_C_RULES = r"""
Top <- Item*
TypeTok <- id / num / str / '::' / ',' / '*' / '&' / '&&' / '...' / <Args> / <Params> / <Cast> / <Index> / 'struct' / 'class' / 'typename' / 'enum' / 'union' / '='
TargsA <- '<' TypeTok* '>'
TargsB <- '<' (TypeTok / TargsA)* '>'
Targs <- '<' (TypeTok / TargsB)* '>'
TName <- '::'? id Targs? ('::' '~'? id Targs?)*
Ptr <- '*' / '&' / '&&'
Tag <- 'struct' / 'class' / 'union' / 'enum' / 'typename'
SpecNext <- Ptr* ('::'? id / Tag / <PtrDecl> / 'operator' / '~')
Attr <- <Index> &(id / Tag / <Index> / '::')
SpecTok <- Attr / Tag Attr? TName &SpecNext / TName &SpecNext
Head <- SpecTok (SpecTok / Ptr)*
OpName <- 'operator' (binop / assign / '=' / Ptr / '<' / '>' '>'? / '+' / '-' / '!' / '~' / incdec / ',' / '->' / <Index> / <Args> / 'new' / 'delete' / str id / TName Ptr*)
DName <- OpName / TName ('::' OpName)? / <PtrDecl>
Declr <- DName (<Params> / <Index>)* id*
InitD <- Declr (':' Tern)? ('=' (Expr / <Init>) / <Init> / <Args>)?
Decl <- Head InitD (',' Ptr* InitD)* / Tag TName
Bases <- ':' (TName / ',' / access)+
Agg <- ('struct' / 'class' / 'union') Attr? <Args>? (TName !TName / id TName)? Bases? <Members> / 'enum' ('class' / 'struct')? TName? (':' TName id*)? <Enums>
AggDecl <- (id !id)? id* Agg (id &(id / Ptr))* (Ptr* InitD (',' Ptr* InitD)*)? ';'
Typedef <- 'typedef' (Agg (id &(id / Ptr))* Ptr* InitD (',' Ptr* InitD)* / Decl) ';'
Using <- 'using' ('namespace' / TypeTok / Targs / Ptr)+ ';'
CtorInit <- TName (<Args> / <Init>) '...'?
FTail <- (id <Args>? / '&' / '&&' / '->' Tag? TName Ptr* / 'throw' <Params>?)* ('try'? ':' CtorInit (',' CtorInit)*)?
FName <- OpName / '~' id / TName ('::' (OpName / '~' id))?
Func <- Head? (FName / <PtrDecl>) <Params> <Params>? FTail <Stmts>
CtorDecl <- id* '~'? id <Params> FTail ('=' ('default' / 'delete' / num))? ';'
OpDecl <- Head? FName <Params> FTail '=' ('default' / 'delete' / num) ';'
Item <- ('template' Targs?)* (';' / 'namespace' id* ('::' id)* <Top> / id 'namespace' id ('::' id)* <Top> / id str <Top> / (id str)? (Using / Typedef / AggDecl / Func / OpDecl / Decl ';') / id <Args> (';' / &id))
Member <- access id? ':' / CtorDecl / Item
Members <- Member*
Enum1 <- id <Args>? ('=' Tern)?
Enums <- (Enum1 (',' Enum1)* ','?)?
Label <- 'case' Tern ('...' Tern)? ':' / 'default' ':' / id ':' !':'
Prefix <- Label / 'if' id? <Cond> / 'else' / 'while' <Cond> / 'for' <For> / 'switch' <Cond> / 'do' / 'try'
Simple <- <Stmts> / ';' / 'return' (Comma / <Init>)? ';' / 'break' ';' / 'continue' ';' / 'goto' Ptr? id ';' / 'catch' <Params> <Stmts> / 'while' <Cond> ';' / Using / Typedef / AggDecl / Decl ';' / Comma ';' / id* <Toks> ';'
Stmt <- Prefix* Simple
Stmts <- Stmt* Label*
Comma <- Expr (',' Expr)*
Expr <- Tern (('=' / assign) (Tern / <Init>))*
BinA <- Bin (('=' / assign) Bin)*
Tern <- Bin ('?' (Bin '?' BinA ':' BinA / BinA (',' BinA)*)? ':' (BinA / 'throw' Bin))*
BinOp <- binop / '+' / '-' / '*' / '&' / '&&' / '<' / '>' '>'?
Bin <- Un (BinOp Un)*
Start <- id / num / str / '::' / <Args> / <Cast> / '!' / '~' / 'sizeof' / 'new'
Pre <- '!' / '~' / '-' / '+' / '*' / '&' / '&&' / incdec / 'throw' / 'delete' <Index>? / <Cast> &Start / !<Args> <Cast>
NewE <- 'new' <Args>? (TName / <Cast>) Ptr* <Index>? (<Args> / <Init>)?
Un <- Pre* Prim Post*
Lambda <- <Cap> <Params>? FTail <Stmts>
Prim <- str (str / id str)* / num id? / Lambda / NewE / 'sizeof' '...'? (<Cast> / <Args> / Un1) / 'operator' / id str / TName <Init> !Post0 / EName / <Args> / <Init> / 'throw'
Post0 <- 'else'
EName <- '::'? id ('::' ('~'? id / OpName))*
Un1 <- ('*' / '&' / '-' / '!' / '~')* (id / num / str / <Args>) Post*
Post <- ('.' / '->') ('~'? id / 'template' id / OpName / '*' Prim0) / <Args> / <Index> / incdec / '::' id
Prim0 <- id / <Args>
Args <- (ArgE (',' ArgE)* (';' ArgE?)*)?
ArgE <- Expr '...'? &(',' / ';' / End) / <Init> / Cast / Params1
End <- !any
Params1 <- '...' / ((Attr / Tag? TName / Ptr / '...' / 'enum')+ (<PtrDecl> / <Params> / <Index>)* ('=' (Tern / <Init>))?)
Params <- (Params1 (',' Params1)*)?
Cast <- Tag? TName (Tag? TName / Ptr)* (<PtrDecl> / <Params> / <Index>)*
Cond <- (Decl ';' / Comma ';')? (Head InitD End / Comma)
For <- (Decl &';' / Comma)? ';' Comma? ';' Comma? / Head (<Index> / DName) ':' Expr
PtrDecl <- (TName '*' / Ptr / '^')+ (Ptr / id)* (<Params> / <Index>)* / <PtrDecl> (<Params> / <Index>)+
Index <- (ArgE (',' ArgE)*)? / <Index>
Cap <- (('&' / '=' / '*')? (id ('=' Tern)? '...'?)? ','?)*
InitE <- ((('.' id) / <Index>)+ '=' / id ':')? (Expr '...'? / <Init>)
Init <- (InitE (',' InitE)* ','?)?
Toks <- str (':' / ',' / str / <Args> / <Index> / id)*
"""


@cache
def c_family() -> Grammar:
    brackets = [
        Bracket("(", ")", ["Args", "Params", "Cast", "Cond", "For", "PtrDecl", "Toks"]),
        Bracket("[", "]", ["Index", "Cap"]),
        Bracket("{", "}", ["Stmts", "Init", "Members", "Enums", "Top"]),
    ]
    classes = {
        "binop": ["/", "%", "|", "^", "||", "<<", "==", "!=", "<=", ">=", "<=>", ".*", "->*", "and", "or"],
        "assign": ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="],
        "incdec": ["++", "--"],
        "access": ["public", "private", "protected"],
    }
    return Grammar(_C_RULES, brackets, classes, statements=("Stmt", "Item", "Member"))


_JAVA_RULES = r"""
QName <- anyword ('.' (anyword / '*'))*
Id <- id / soft
Annot <- '@' QName <Args>?
TypeTok <- Id / ',' / '.' / '?' / '&' / 'extends' / 'super' / <Index> / Annot / <Args>
TargsA <- '<' TypeTok* '>'
TargsB <- '<' (TypeTok / TargsA)* '>'
Targs <- '<' (TypeTok / TargsB)* '>'
Type <- ('ref' 'readonly'?)? (Annot* Id Targs? ('.' Annot* Id Targs?)* / <Tuple>) '?'? (<Rank> '?'? / '*')*
NameNext <- Id / 'this' / 'operator' / 'enum' / 'class' / 'interface' / 'event' / mod
Head1 <- mod / Annot / Targs &NameNext / 'event' / 'const' / 'new' &NameNext / ('explicit' / 'implicit') &'operator' / 'default' &(Type NameNext) / Type &(NameNext)
Head <- (<Attr>* Head1)+
Throws <- 'throws' Type (',' Type)*
Where <- ('where' Id ':' (Type / 'class' / 'struct' / 'new' <Args> / ',')+)*
CtorCall <- ':' ('base' / 'this') <Args>
Body <- <Stmts> / '=>' Expr ';' / ';' / 'default' (Lit / <Init> / Annot) ';'
OpName <- 'operator' ('true' / binop / '+' / '-' / '*' / '&' / '<' / '>' / '!' / '~' / incdec / Type)
MName <- (Type '.')? ('this' / OpName / '~'? Id) / '~' Id
Method <- <Attr>* Head? (OpName / '~'? Id) Targs? <Params> <Rank>* Throws? CtorCall? Where Body
Field1 <- Id <Rank>* ('=' (Expr / <Init>))?
Field <- <Attr>* Head Field1 (',' Field1)* ';'
Prop <- <Attr>* Head ('this' <Params1>? / Id) ('.' Id)* (<Index>)? (<Accessors> ('=' (Expr / <Init>) ';')? / '=>' Expr ';')
Accessors <- (<Attr>* mod* Id (';' / <Stmts> / '=>' Expr ';'))+
TypeHead <- (<Attr>* (mod / Annot / soft &(soft / mod / 'class' / 'struct' / 'interface' / 'enum' / id) / 'new' / 'ref'))* <Attr>*
Supers <- (('extends' / 'implements' / ':' / 'permits') Type <Args>? (',' Type)*)*
TypeDecl <- TypeHead (('class' / 'interface' / 'struct' / '@' 'interface' / 'record' ('class' / 'struct')?) Id Targs? <Params>? Supers Where (<Members> / ';') / 'enum' Id Supers <EnumBody> / 'delegate' Type Id Targs? <Params> Where ';') ';'?
Member1 <- ';' / mod? <Stmts> / TypeDecl / Method / Prop / Field
Members <- Member1*
EnumC <- (Annot / <Attr>)* Id <Args>? ('=' Tern)? <Members>?
EnumBody <- (EnumC (',' EnumC)*)? ','? (';' Members)?
Label <- 'case' Pats Guard? (':' / '->') / 'default' (':' / '->') / Id ':' !':'
Guard <- 'when' Tern
Pats <- Pat (',' Pat)*
Pat <- 'default' / 'var' Id / Tern (Id / <PropPat> Id?)? / Type <PropPat>? Id?
Prefix <- Label / 'if' <Args> / 'else' / 'while' <Args> / ('for' / 'foreach') <For> / 'await' 'foreach' <For> / 'do' / 'switch' <Args> / 'try' <Res>? / ('synchronized' / 'lock' / 'fixed' / 'using') <Res> / 'unsafe' &<Stmts> / 'checked' &<Stmts>
LocalFunc <- <Attr>* Head Id Targs? <Params> Where (<Stmts> / '=>' Expr ';')
VarDecl <- ('await'? 'using')? Head Field1 (',' Field1)* / 'var' Id '=' Expr / 'var' <Args> '=' Expr
Simple <- <Stmts> / ';' / 'return' Expr? ';' / 'throw' Expr? ';' / 'break' Id? ';' / 'continue' Id? ';' / 'goto' ('case' Tern / 'default' / Id) ';' / 'yield' ('return' Expr / 'break' / Expr) ';' / 'catch' <Params>? ('when' <Args>)? <Stmts> / 'finally' <Stmts> / TypeDecl / LocalFunc / VarDecl ';' / Expr ';' / 'assert' Tern (':' Expr)? ';'
Stmt <- Prefix* Simple
Stmts <- Stmt* Label*
LamHead <- (mod / 'async')* (Id / <Params> / <Args>) ('->' / '=>')
Val <- LamHead+ (<Stmts> / Tern) / 'delegate' <Params>? <Stmts> / Tern
Expr <- Val (('=' / assign) (Val / <Init>))*
Bin0 <- Bin (('=' / assign) Bin)*
Tern <- Bin ('?' (Bin0 '?' Bin0 ':' Bin0 / LamHead* Bin0) ':' LamHead* ('throw' Bin / Bin0))*
BinOp <- binop / '+' / '-' / '*' / '&' / '<' / '>' '>'? '>'?
IsPat <- 'not'? ('null' / mod? Type <PropPat>? (!('and' / 'or') Id)? / <PropPat> / <Args> / Lit) (('and' / 'or') 'not'? (Type <PropPat>? / <PropPat> / Lit / ('<' / '>' / binop) Lit))*
Bin <- Un (BinOp ('throw')? Un / ('is' / 'instanceof') IsPat / 'as' Type)*
Start <- id / soft / num / str / <Args> / '!' / '~' / 'new' / 'this' / 'super' / 'base' / 'switch'
Pre <- '!' / '~' / '-' / '+' / '&' / '*' / incdec / 'await' / 'ref' / 'out' / 'in' / <Cast> &Start / !<Args> <Cast> / 'throw'
Rank0 <- (<Index> / <Rank>)+
NewE <- 'new' Targs? (Annot* TypeName (Rank0 <Init>? / <Args> (<Members> / <Init>)? / <Init>) / <Args> <Init>? / Rank0? <Init>)
TypeName <- (Id Targs? ('.' Id Targs?)* / <Tuple>) '?'?
Lit <- ('-')? num / str+
Un <- Pre* Prim Post*
Prim <- num / str+ / NewE / ('this' / 'super' / 'base') / 'switch' <Args> <Stmts> / ('typeof' / 'sizeof' / 'default' / 'checked' / 'nameof') <Args> / 'default' / 'stackalloc' Type <Index> / Id !(Id &('-' '>')) / <Args> / <Index>
Post <- ('.' / '?' '.' / '?.') Targs? ('new' NewRest / 'class' / 'this' / 'super' / Id) / '::' Targs? (Id / 'new') / Targs &(<Args> / '::') / <Args> / <Index> / '?' <Index> / <Rank> &('.' / '::') / incdec / '!' !'=' / 'switch' <Arms> / 'with' <Init>
NewRest <- Id Targs? <Args> <Members>?
Arms <- (Arm (',' Arm)* ','?)?
Arm <- Pats Guard? '=>' Expr
Args <- (ArgE (',' ArgE)*)?
ArgE <- (Id ':')? (('out' / 'ref' / 'in') (('var' / Type) Id / Expr) / Expr &(',' / End) / Type / Annot '='? / Id '=' <Init>)
End <- !any
Params1 <- (<Attr> / Annot / mod / 'this' / 'ref' / 'out' / 'in' / 'params')* Type (binop Type)* ('...' / Annot)* (Id / 'this' / Id '.' 'this')? <Rank>* ('=' Tern)?
Params <- (Params1 (',' Params1)*)?
Cast <- Type ('&' Type)*
Tuple <- Type Id? (',' Type Id?)+
For <- (VarDecl / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)? / Head Id (':' / 'in') Expr / 'var' (<Args> / Id) (':' / 'in') Expr
Res <- (Head Field1 / 'var' Id '=' Expr / Expr) (';' (Head Field1 / 'var' Id '=' Expr / Expr)?)*
Index <- '^'? Expr (',' Expr)* / ('^'? Expr)? '..' ('^'? Expr)?
Rank <- ','*
Attr <- (Id ':')? QName <Args>? (',' QName <Args>?)*
InitE <- (QName '=' / <Index> '=')? (Expr / <Init>) / Annot
Init <- (InitE (',' InitE)* ','?)? / ','
PropPat <- ((QName ':' Pat) (',' QName ':' Pat)* ','?)?
"""
_JAVA_TOP = "Top <- (Annot* 'package' QName ';')? ('import' mod? QName ';' / ';')* TypeDecl*\n"
_CS_TOP = """
Import <- (mod / 'extern')? 'using' mod? (Id '=')? Type ';'
Top <- Import* (<Attr> !<Attr>)? ('namespace' QName ';' Import*)? (Space / TypeDecl / TopStmt)*
Space <- 'namespace' QName <NsBody> ';'?
NsBody <- Import* (Space / TypeDecl)*
TopStmt <- Prefix* Simple
"""


#: Words with a place in expressions or types, which would be mistaken there.
NOT_NAMES = {"is", "as", "in", "out", "ref", "base", "operator", "event", "delegate", "explicit", "implicit", "await", "params", "switch", "lock", "fixed", "checked", "not"}


#: Words of C# that Java does not reserve.
CSHARP_ONLY = [
    "lock", "fixed", "checked", "unsafe", "event", "delegate", "operator", "explicit", "implicit", "is", "as", "in", "out", "ref", "base", "params", "foreach", "struct",
    "namespace", "using", "virtual", "override", "readonly", "internal", "async", "await", "get", "set", "init", "required", "partial", "extern", "typeof", "sizeof",
    "nameof", "stackalloc", "where", "not", "and", "or", "with",
]


def _java_like(top: str, blocks: list[str]) -> Grammar:
    brackets = [
        Bracket("(", ")", ["Args", "Params", "Cast", "For", "Res", "Tuple"]),
        Bracket("[", "]", ["Index", "Rank", "Attr", "Params1"]),
        Bracket("{", "}", ["Stmts", "Members", "EnumBody", "Init", "Accessors", "Arms", "PropPat", *blocks]),
    ]
    classes = {
        "binop": ["/", "%", "|", "^", "||", "&&", "<<", "==", "!=", "<=", ">=", "??", ".."],
        "assign": ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "??="],
        "incdec": ["++", "--"],
        "mod": ["public", "private", "protected", "static", "final", "abstract", "native", "transient", "volatile", "strictfp", "virtual", "override", "readonly", "internal", "sealed", "unsafe"],
        "soft": ["async", "partial", "record", "var", "get", "set", "init", "required", "extern", "non", "true", "null", "where", "when", "not", "and", "or", "yield", "await", "nameof", "with", "as", "is", "base", "params", "out", "in", "ref", "event", "operator", "explicit", "implicit", "delegate", "lock", "checked", "fixed", "permits"],
    }
    rules = top + _JAVA_RULES
    if not blocks:  # words of C# alone are names in Java: as tokens that never come they leave its rules empty
        for word in CSHARP_ONLY:
            rules = rules.replace(f"'{word}'", f"'#{word}'")
        classes = {k: [w for w in v if w not in CSHARP_ONLY] for k, v in classes.items()}
    # words that only mean something in their place are names elsewhere
    soft = [x for x in classes["soft"] if f"'{x}'" in rules and x not in NOT_NAMES]
    classes["soft"] = [x for x in classes["soft"] if f"'{x}'" not in rules]
    rules = rules.replace("Id <- id / soft", "Id <- id / soft / " + " / ".join(f"'{x}'" for x in soft))
    return Grammar(rules, brackets, classes, statements=("Stmt", "Member1"))


@cache
def java() -> Grammar:
    return _java_like(_JAVA_TOP, [])


@cache
def csharp() -> Grammar:
    return _java_like(_CS_TOP, ["NsBody"])


_JS_RULES = r"""
Top <- Stmts
Sep <- ';' / nl
End <- Sep / !any / &'else'
Id <- id / soft
TypeTok <- Id / str / num / '|' / '&' / ',' / '.' / '[' / <Args> / <Array> / <Object> / <TypeBody> / <Params> / '=>' / ':' / '?' / 'typeof' / 'extends' / '=' / 'void' / 'new' / 'in' / '-'
TargsA <- '<' TypeTok* '>'
TargsB <- '<' (TypeTok / TargsA)* '>'
Targs <- '<' (TypeTok / TargsB)* '>'
TPrim <- ('typeof' / 'new' / '-')* (Id ('.' anyword)* Targs? / str / num / <Params> '=>' TOne / Targs <Params> '=>' TOne / <TypeBody> / <Object> / <Array> / <Args> / 'void' / 'import' <Args> ('.' id)*) <Array>*
TOne <- (Id !'.')? (Id TPrim0)? TPrim0
TPrim0 <- ('typeof' / '-')* (Id ('.' anyword)* Targs? / str / num / 'void' / <TypeBody> / <Object> / <Array> / <Args> / <Params>) <Array>*
TypeE <- ('|' / '&')? TUn (('|' / '&') TUn)* ('extends' TUn (('|' / '&') TUn)* '?' TUn (('|' / '&') TUn)* ':' TUn (('|' / '&') TUn)*)?
TUn <- (Id &(Id / <TypeBody> / <Array> / <Args> / str) !(Id End))? TPrim ('is' TPrim)?
Ann <- '?'? ':' TypeE
VarKw <- 'const' / 'let' / 'var'
Bind1 <- (Id / <Object> / <Array>) '!'? Ann? ('=' Val)?
VarDecl <- VarKw nl* Bind1 (',' Bind1)*
Func <- 'async'? 'function' '*'? Id? Targs? <Params> Ann? <Stmts>
FuncSig <- 'async'? 'function' Id Targs? <Params> Ann? End
Decor <- '@' Id ('.' id)* <Args>? nl*
Class <- Decor* 'class' (!('extends') Id)? Targs? ('extends' ClassRef)? ('implements' TypeE (',' TypeE)*)? <ClassBody>
ClassRef <- (Id / <Args> / Func) ('.' anyword / <Args> / Targs)*
Key <- anyword / str / num / <Array> / '#' anyword
Mods <- (anyword &(anyword / str / num / '*' / <Array> / '#'))*
Member <- Decor* ('static' <Stmts> / Mods '*'? Key ('?' / '!')? Targs? (<Params> Ann? (<Stmts> / End) / Ann? ('=' Expr)? End))
ClassBody <- (Sep / Member)*
Prop <- '...' Val / Mods '*'? Key <Params> Ann? <Stmts> / Key ':' Val / Id ('=' Val)?
Object <- (Prop (',' Prop)* ','?)?
TypeMember <- Mods ('-' / '+')? (Key '?'? Targs? <Params> Ann? / ('new')? Targs? <Params> Ann / Key ('-' / '+')? '?'? Ann / <Array> ('-' / '+')? '?'? Ann / Key '?'?)
TypeBody <- (TypeMember? (Sep / ','))* TypeMember?
EnumBody <- (Sep)* (EnumC (',' nl* EnumC)* ','? nl*)?
EnumC <- (anyword / str) ('=' Val)?
Names <- (Name1 (',' nl* Name1)* ','?)?
Name1 <- nl* 'type'? (anyword / str) ('as' (anyword / str))? nl*
ImpC <- 'type'? ((Id / '*' 'as' Id / <Names>) (',' ('*' 'as' Id / <Names>))*) 'from' str
Import <- 'import' (ImpC / str / 'type'? Id '=' Val) (('with' / 'assert') <Object>)? End
Export <- 'export' (('default' (Func / Class / 'abstract' Class / Val End)) / 'type'? <Names> ('from' str)? End / '*' ('as' (anyword / str))? 'from' str End / '=' Val End / Item / VarDecl End)
Item <- ('declare' / 'abstract')* (Func / FuncSig / Class / 'interface' Id Targs? ('extends' TypeE (',' TypeE)*)? (<TypeBody> / <Object>) / 'type' Id Targs? '=' nl* TypeE End / 'const'? 'enum' Id <EnumBody> / ('namespace' / 'module') (Id ('.' Id)* / str) <Stmts> / 'declare' VarDecl End)
Prefix <- 'if' <Args> nl* / 'else' nl* / 'while' <Args> nl* / 'for' 'await'? <For> nl* / 'with' <Args> nl* / 'do' nl* / Id ':' nl*
Body <- 'switch' <Args> <Cases> / 'try' <Stmts> / 'catch' <Params>? <Stmts> / 'finally' <Stmts> / Import / Export / Item / <Stmts> / (VarDecl / 'return' Comma? / 'throw' Comma / 'break' Id? / 'continue' Id? / 'debugger' / Comma) End / ';' / 'while' <Args> End
Stmt <- 'while' <Args> (Sep / !any) / Prefix* Body
Stmts <- (Sep / Stmt)*
Cases <- nl* (('case' Comma / 'default') ':' (Sep / Stmt)*)*
Comma <- Expr (',' Expr)*
Arrow <- 'async'? Targs? (Id / <Params> Ann?) '=>' nl*
Val <- Arrow+ (<Stmts> / Asg) / Asg
Asg <- Tern (('=' / assign) (Arrow+ (<Stmts> / Tern) / Tern))*
Expr <- Val
TernA <- Arrow+ (<Stmts> / Bin) / Bin (('=' / assign) (Arrow+ (<Stmts> / Bin) / Bin))*
Tern <- Bin ('?' (Bin '?' TernA ':' TernA / TernA) ':' TernA)*
BinOp <- binop / '+' / '-' / '*' / '<' / '>' '>'? '>'? / 'in' / '|' / '&'
Bin <- Un (BinOp nl* Un / ('as' / 'satisfies') TypeE)*
Pre <- '!' / '~' / '-' / '+' / incdec / 'typeof' / 'void' / 'delete' / 'await' / 'yield' '*'? / 'new' &(Id / 'new' / 'this' / 'class' / <Args> / 'function' / 'import')
Un <- Pre* Prim Post* / 'yield' / 'await'
Prim <- num / str / 'this' / 'super' / 'new' '.' id / 'import' ('.' id / <Args>) / Func / Class / Id / <Args> / <Array> / <Object> / '#' id
Post <- '.' ('#'? anyword) / '?.' ('#'? anyword / <Args> / <Array>) / <Args> / <Array> / incdec / '!' &('.' / <Array> / <Args> / ')' / ';' / ',' / nl / End) / Targs <Args> / tmpl
Args <- (ArgE (',' ArgE)* ','?)?
ArgE <- '...'? Expr (',' Expr)*
Param1 <- Decor* Mods '...'? (Id / 'this' / <Object> / <Array>) '?'? Ann? ('=' Val)?
Params <- (Param1 (',' Param1)* ','?)?
For <- (VarKw? (Id / <Object> / <Array>) / Un) ('of' / 'in') Comma / (VarDecl / Comma)? ';' Comma? ';' Comma?
Array <- ','* (('...'? Val) (',' (','* '...'? Val))* ','*)? / Id ':' TypeE / TypeE (',' (Id ':')? TypeE)* / Id 'in' TypeE ('as' TypeE)?
"""


@cache
def javascript() -> Grammar:
    brackets = [
        Bracket("(", ")", ["Args", "Params", "For"]),
        Bracket("[", "]", ["Array"]),
        Bracket("{", "}", ["Stmts", "Object", "ClassBody", "Cases", "TypeBody", "EnumBody", "Names"], lines=True),
    ]
    classes = {
        "binop": ["/", "%", "^", "||", "&&", "??", "<<", "==", "!=", "===", "!==", "<=", ">=", "**", "instanceof"],
        "assign": ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??="],
        "incdec": ["++", "--"],
        "soft": ["get", "set", "static", "of", "async", "from", "as", "type", "declare", "abstract", "namespace", "module", "is", "satisfies", "assert", "interface", "implements"],
        "tmpl": ["`"],
    }
    soft = [x for x in classes["soft"] if f"'{x}'" in _JS_RULES]
    classes["soft"] = ["get", "set"]
    return Grammar(_JS_RULES.replace("Id <- id / soft", "Id <- id / soft / " + " / ".join(f"'{x}'" for x in soft)), brackets, classes, newline="\n", statements=("Stmt", "Member"), ends=(";", "\n"))


_GO_RULES = r"""
Top <- ';'* 'package' id ';' (';' / Import)* (';' / TopDecl (';' / !any))*
Import <- 'import' (ImpSpec / <ImpGroup>) ';'
ImpSpec <- (id / '.')? str
ImpGroup <- ';'* (ImpSpec (';' / !any) ';'*)*
TopDecl <- 'func' <Params>? id <Index>? <Params> Result? <Stmts>? / DeclS
DeclS <- 'var' (VarSpec / <VarGroup>) / 'const' (VarSpec / <VarGroup>) / 'type' (TypeSpec / <TypeGroup>)
VarSpec <- id (',' id)* (!'=' Type)? ('=' ExprL)?
VarGroup <- ';'* (VarSpec (';' / !any) ';'*)*
TypeSpec <- id (<Index> &(Type0))? '='? Type
TypeGroup <- ';'* (TypeSpec (';' / !any) ';'*)*
Type0 <- '*' / id / 'struct' / 'interface' / 'func' / 'map' / 'chan' / <Index> / '<-' / <Args>
TPre <- '*' / <Index> / 'map' <Index> / 'chan' '<-'? / '<-' 'chan' / '...'
Sig <- <Params> (TPre* TBase1)?
TBase1 <- id ('.' id)? <Index>? / 'struct' <Fields> / 'interface' <Iface> / <Params> / 'func' <Params>
TBase <- id ('.' id)? <Index>? / 'struct' <Fields> / 'interface' <Iface> / 'func' Sig / <Args> / <Params>
Type <- TPre* TBase
Result <- <Params> / Type
Field <- id (',' id)* Type str? / '*'? id ('.' id)? <Index>? str?
Fields <- ';'* (Field (';' / !any) ';'*)*
Iface <- ';'* ((id <Params> Result? / ('~' / '|' / Type)+) (';' / !any) ';'*)*
ForHead <- (SimpleH? ';' ExprH? ';' SimpleH? / RangeH / ExprH)?
RangeH <- (ExprHL (':=' / '='))? 'range' ExprH
Header <- (SimpleH? ';')? (SimpleH)?
SwHead <- (SimpleH? ';')? ((id ':=')? PrimH PostH* '.' <TypeSw> / SimpleH)?
If <- 'if' Header <Stmts> ('else' 'if' Header <Stmts>)* ('else' <Stmts>)?
Stmt <- If / 'for' ForHead <Stmts> / 'switch' SwHead <Cases> / 'select' <Cases> / 'return' ExprL? / ('defer' / 'go') Expr / ('break' / 'continue' / 'goto') id? / 'fallthrough' / DeclS / <Stmts> / Simple
Labeled <- (id ':' ';'*)* Stmt
Stmts <- ';'* (Labeled (';'+ / !any))* (id ':' ';'*)?
Cases <- ';'* (('case' CaseL / 'default') ':' Stmts1)*
CaseL <- (Simple / Type) (',' (Expr / Type))*
Stmts1 <- ';'* (!('case' / 'default') Labeled (';'+ / !any))*
Simple <- ExprL (':=' / '=' / assign) ('range' Expr / ExprL) / Expr (incdec / '<-' Expr)?
SimpleH <- ExprHL (':=' / '=' / assign) ('range' ExprH / ExprHL) / ExprH (incdec / '<-' ExprH)?
ExprL <- Expr (',' Expr)*
ExprHL <- ExprH (',' ExprH)*
BinOp <- binop / '+' / '-' / '*' / '&' / '^' / '|'
Expr <- Un (BinOp Un)*
ExprH <- UnH (BinOp UnH)*
Pre <- '-' / '+' / '!' / '^' / '*' / '&' / '<-'
Un <- Pre* Prim Post*
UnH <- Pre* PrimH PostH*
FuncLit <- 'func' <Params> Result? <Stmts>
TypeLit <- (<Index> / 'map' <Index> / 'chan')+ TPre* TBase / 'struct' <Fields> / 'interface' <Iface> / 'func' Sig
Prim <- FuncLit / num / str / TypeLit / id / <Args> / <Params>
PrimH <- FuncLit / num / str / TypeLit <Init>? / id / <Args>
Post0 <- '.' id / '.' <TypeSw> / '.' <Args> / <Args> / <Index>
PostH <- '.' id / '.' <Args> / <Args> / <Index>
Post <- Post0 / <Init>
Args <- (ArgE (',' ArgE)* ','?)?
ArgE <- Expr '...'? &(',' / !any) / Type
TypeSw <- 'type'
Param1 <- id (',' id)* '...'? Type &(',' / !any) / Type
Params <- (Param1 (',' Param1)* ','?)?
Index <- (Bound (':' Bound?)* / ':' Bound? (':' Bound?)? / ArgI (',' ArgI)* ','?)? / '...'
Bound <- Expr &(':' / !any)
ArgI <- id (',' id)* ('~' / '|' / Type)+ / Expr &(',' / !any) / Type
El <- (Expr / <Init>) (':' (Expr / <Init>))?
Init <- (El (',' El)* ','?)?
"""


@cache
def go() -> Grammar:
    brackets = [
        Bracket("(", ")", ["Args", "Params", "ImpGroup", "VarGroup", "TypeGroup", "TypeSw"]),
        Bracket("[", "]", ["Index"]),
        Bracket("{", "}", ["Stmts", "Fields", "Iface", "Cases", "Init"]),
    ]
    classes = {
        "binop": ["/", "%", "||", "&&", "<<", ">>", "&^", "==", "!=", "<", ">", "<=", ">="],
        "assign": ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="],
        "incdec": ["++", "--"],
    }
    return Grammar(_GO_RULES, brackets, classes, statements=("Labeled",))


_RUST_RULES = r"""
Top <- InnerAttr* Item*
Toks <- any*
InnerAttr <- '#' '!' <Toks>
Attr <- '#' <Toks>
Vis <- 'pub' <Toks>?
Id <- id / 'union' / 'auto' / 'default'
TypeTok <- Id / life / ',' / '::' / '&' / '&&' / '*' / 'mut' / 'const' / 'dyn' / 'impl' / '=' / '+' / ':' / '?' / <Tup> / <Arr> / '->' / 'fn' / num / str / 'for' / <Stmts> / '!' / '-' / 'unsafe' / 'extern' / 'self' / 'crate' / 'super' / 'where'
TargsA <- '<' TypeTok* '>'
TargsB <- '<' (TypeTok / TargsA)* '>'
TargsC <- '<' (TypeTok / TargsB / 'as')* '>'
Targs <- '<' (TypeTok / TargsC / 'as')* '>'
Seg <- Id / 'self' / 'super' / 'crate'
TPath <- (Targs '::')? '::'? Seg Targs? (<Tup> ('->' TOne)?)? ('::' (Seg Targs? / Targs))*
TOne <- TPre* (<Tup> / <Arr> / '!' / Seg Targs? ('::' Seg Targs?)*)
TPre <- '&' life? / '&&' life? / 'mut' / '*' ('const' / 'mut') / 'dyn' / 'impl' / '?' / 'for' Targs
FnType <- 'unsafe'? ('extern' str?)? 'fn' <Tup> ('->' TOne)?
Type1 <- TPre* (FnType / TPath / <Tup> / <Arr> / '!' / life / Id '!' <Toks>)
Type <- Type1 ('+' Type1)*
Bounds <- ':' (Type1 ('+' Type1)*)? '+'?
Where <- 'where' ((life / Type) Bounds ','?)*
Generics <- Targs
UseTree <- '::'? (Seg '::')* (Seg ('as' Id)? / '*' / <UseList>)
UseList <- (UseTree (',' UseTree)* ','?)?
FnQual <- ('const' / 'async' / 'unsafe' / 'extern' str?)*
Fn <- FnQual 'fn' Id Generics? <Params> ('->' Type)? Where? (<Stmts> / ';')
Macro <- (Seg '::')* Seg '!' Id? <Toks>
Item <- Attr* Vis? 'default'? (Use / Fn / 'mod' Id (';' / <Top>) / Struct / 'enum' Id Generics? Where? <Variants> / ('unsafe' / 'auto')* 'trait' Id Generics? Bounds? Where? <Items> / 'unsafe'? 'impl' (Generics &(Type / '!'))? '!'? Type ('for' Type)? Where? <Items> / 'type' Id Generics? Bounds? Where? ('=' Type)? Where? ';' / 'const' Id (':' Type)? ('=' Expr)? ';' / 'static' 'mut'? Id ':' Type ('=' Expr)? ';' / 'unsafe'? 'extern' (str? <Items> / 'crate' Seg ('as' Id)? ';')) / Attr* Macro ';'?
Use <- 'use' UseTree ';'
Struct <- ('struct' / 'union') Id Generics? Where? (<Fields> / <TupFields> Where? ';' / ';')
Items <- InnerAttr* Item*
Field <- Attr* Vis? Id ':' Type
Fields <- (Field (',' Field)* ','?)?
TupFields <- (Attr* Vis? Type (',' Attr* Vis? Type)* ','?)?
Variant <- Attr* Vis? Id (<Fields> / <TupFields>)? ('=' Expr)?
Variants <- (Variant (',' Variant)* ','?)?
Params <- (Param (',' Param)* ','?)?
Param <- Attr* (('&' life?)? 'mut'? 'self' (':' Type)? / Pat ':' Type / '...' / Type)
Pat <- '|'? Pat1 ('|' Pat1)*
Lit <- '-'? num / str
PEnd <- Lit / TPathE
TPathE <- (Targs '::')? '::'? Seg ('::' (Seg / Targs))*
Pat1 <- ('&' / '&&' / 'ref' / 'mut')* (Id '@')? (Macro / Lit (('..=' / '..' / '...') PEnd?)? / TPathE (<PatTup> / <PatStruct>)? (('..=' / '..') PEnd)? / <PatTup> / <PatArr> / ('..=' / '..') PEnd?) / ('&' / '&&' / 'mut')+ (Id '@')? <PatTup>
PatTup <- (Pat (',' Pat)* ','?)?
PatArr <- (Pat (',' Pat)* ','?)?
PatField <- Attr* ('ref' / 'mut')* ((Id / num) ':' Pat / Id) / '..'
PatStruct <- (PatField (',' PatField)* ','?)?
Stmt <- ';' / Attr* 'let' Pat (':' Type)? ('=' Expr ('else' <Stmts>)?)? ';' / Expr ';' / Item / Attr* Block ';'? / Macro
Stmts <- InnerAttr* Stmt* (Attr* Expr)?
Label <- (life ':')?
If <- 'if' Cond <Stmts> ('else' 'if' Cond <Stmts>)* ('else' <Stmts>)?
Block <- Label (If / 'match' ExprH <Arms> / 'while' Cond <Stmts> / 'loop' <Stmts> / 'for' Pat 'in' ExprH <Stmts> / ('unsafe' / 'const' / 'async' 'move'?)? <Stmts>) PostB*
PostB <- '?' / '.' (Id ('::' Targs)? / num) <Args>?
Cond <- CondP ('&&' CondP)*
CondP <- 'let' Pat '=' BinLet / ExprH
BinLet <- UnH (BinOpLet UnH / 'as' Type)*
BinOpLet <- binop / '+' / '-' / '*' / '&' / '|' / '..' / '..=' / '<' / '>' '>'?
BinOp <- BinOpLet / '&&' / '||'
Closure <- ('static' / 'async' / 'move')* ('||' / '|' CParams '|') ('->' Type)?
CParams <- ((Pat1 (':' Type)?) (',' Pat1 (':' Type)?)* ','?)?
Pre <- '-' / '!' / '*' / '&' / '&&' / 'mut' / Closure / 'return' &Start / 'break' life? &Start / 'box' / ('..' / '..=') &Start
Start <- Id / num / str / <Args> / <Arr> / '-' / '!' / '*' / '&' / '&&' / 'self' / 'crate' / 'super' / 'match' / 'if' / '|' / '||' / 'move' / 'unsafe' / '<' / 'loop'
Expr <- Bin (('=' / assign) Bin)*
Bin <- Un (BinOp Un / 'as' Type)* ('..' (BinOp Un)*)?
Un <- Pre* Prim Post*
ExprH <- BinH (('=' / assign) BinH)*
BinH <- UnH (!('&&' 'let') BinOp UnH / 'as' Type)* '..'?
UnH <- Pre* PrimH Post*
Jump <- 'return' / 'break' life? / 'continue' life?
PrimH <- num / str+ / Macro / Block1 / TPathE / <Args> / <Arr> / Jump / '..' / <Stmts> &End0
End0 <- !any / ')'
Block1 <- Label (If / 'match' ExprHM <Arms> / 'loop' <Stmts> / 'unsafe' <Stmts>)
ExprHM <- BinM
BinM <- UnM (BinOp UnM / 'as' Type)*
UnM <- Pre* (num / str / Macro / TPathE / <Args> / <Arr>) Post*
Prim <- num / str+ / Macro / BlockE / TPathE <Struct>? / <Args> / <Arr> / Jump / '..'
BlockE <- Label (IfE / 'match' ExprHM <Arms> / 'while' CondE <Stmts> / 'loop' <Stmts> / 'for' Pat 'in' ExprHM <Stmts> / ('unsafe' / 'const' / 'async' 'move'?)? <Stmts>)
CondE <- CondPE ('&&' CondPE)*
CondPE <- 'let' Pat '=' UnM / ExprHM
IfE <- 'if' CondE <Stmts> ('else' 'if' CondE <Stmts>)* ('else' <Stmts>)?
Post <- '?' / '.' (Id ('::' Targs)? / num / 'await') / <Args> / <Arr>
Args <- (Expr (',' Expr)* ','?)?
Tup <- (TupE (',' TupE)* ','?)?
TupE <- Attr* (Id ':')? Type
Arr <- (Expr (';' Expr / (',' Expr)* ','?))? / Type (';' Expr)?
SField <- Attr* ((Id / num) ':' Expr / Id) / '..' Expr?
Struct0 <- (SField (',' SField)* ','?)?
Guard <- 'if' Cond
Arm <- Attr* Pat Guard? '=>' (Attr* <Stmts> ','? / Attr* Expr (',' / !any) / Attr* Block ','?)
Arms <- InnerAttr* Arm*
"""


@cache
def rust() -> Grammar:
    rules = _RUST_RULES.replace("<Struct>", "<Struct0>")
    brackets = [
        Bracket("(", ")", ["Toks", "Args", "Params", "Tup", "TupFields", "PatTup"]),
        Bracket("[", "]", ["Toks", "Arr", "PatArr"]),
        Bracket("{", "}", ["Toks", "Stmts", "Top", "Items", "Fields", "Variants", "UseList", "PatStruct", "Struct0", "Arms"]),
    ]
    classes = {
        "binop": ["/", "%", "^", "<<", "==", "!=", "<=", ">="],
        "assign": ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="],
        "life": ["'a"],
        "soft": ["$"],
    }
    return Grammar(rules, brackets, classes, statements=("Stmt", "Item"))


_PY_RULES = r"""
Top <- Block
Id <- id / 'match' / 'case' / 'type'
Block <- (nl / Stmt)*
Stmt <- Compound / Line
Line <- Simple (';' Simple)* ';'? nl
Suite <- ':' (Simple (';' Simple)* ';'? nl / nl+ <Block>)
Nls <- nl*
Compound <- ('@' Named nl+)* ('async'? 'def' Id <List>? <Params> ('->' Expr)? Suite / 'class' Id <List>? <Args>? Suite) / 'if' Named Suite (Nls 'elif' Named Suite)* (Nls 'else' Suite)? / 'async'? 'for' TargetL 'in' StarL Suite (Nls 'else' Suite)? / 'while' Named Suite (Nls 'else' Suite)? / 'try' Suite (Nls 'except' '*'? (ExprL ('as' Id)?)? Suite)* (Nls 'else' Suite)? (Nls 'finally' Suite)? / 'async'? 'with' (WithI (',' WithI)* ','? &':' / <WithL>) Suite / 'match' StarL ':' nl+ <Cases>
WithI <- Expr ('as' Target)?
WithL <- WithI (',' WithI)* ','?
Cases <- (nl / 'case' PatL ('if' Named)? Suite)+
PatL <- Pat (',' Pat)* ','?
Pat <- Pat1 ('|' Pat1)* ('as' Id)?
Pat1 <- '*'? ('-'? num (('+' / '-') num)? / str+ / Id ('.' Id)* <Args>? / <Args> / <List> / <Dict> / <PatL>)
Simple <- 'pass' / 'break' / 'continue' / 'return' StarL? / 'raise' (Expr ('from' Expr)?)? / 'del' TargetL / ('global' / 'nonlocal') Id (',' Id)* / 'assert' Expr (',' Expr)? / 'import' Dotted ('as' Id)? (',' Dotted ('as' Id)?)* / 'from' ('.' / '...')* Dotted? 'import' ('*' / <ImpList> / ImpList) / 'type' Id <List>? '=' Expr / Assign
Dotted <- Id ('.' Id)*
ImpList <- Id ('as' Id)? (',' Id ('as' Id)?)* ','?
Assign <- (Targets '=')+ (Yield / StarL) / Un ':' Expr ('=' (Yield / StarL))? / Un assign (Yield / StarL) / Yield / StarL
Targets <- TargetL
TargetL <- Target (',' Target)* ','?
Target <- '*'? Un
Yield <- 'yield' ('from' Expr / StarL)?
StarL <- Star (',' Star)* ','?
Star <- '*' Or / Named
ExprL <- Expr (',' Expr)* ','?
Named <- (Id ':=')? Expr
Lam <- 'lambda' LParams ':'
LParams <- (LParam (',' LParam)* ','?)?
LParam <- '/' / ('*' / '**')? Id ('=' Or)? / '*'
Expr <- Lam* Or ('if' Or 'else' Lam* Or)*
Or <- Not (('and' / 'or') Not)*
Not <- 'not'* Cmp
CmpOp <- '<' / '>' / cmp / 'not' 'in' / 'in' / 'is' 'not'? 
Cmp <- Bit (CmpOp Bit)*
BinOp <- binop / '+' / '-' / '*' / '**' / '/' / '@' / '|'
Bit <- Un (BinOp Un)*
Un <- ('-' / '+' / '~' / 'await')* Prim Post*
Prim <- num / str+ / Id / '...' / <Args> / <List> / <Dict>
Post <- '.' Id / <Args> / <List>
CompFor <- ('async'? 'for' TargetIn 'in' Lam* Or ('if' Lam* Or ('if' !any)?)*)+
TargetIn <- '*'? Un (',' '*'? Un)* ','?
Arg <- '**' Expr / '*' Expr / Id '=' Expr / Named CompFor? / Yield
Args <- (Arg (',' Arg)* ','?)?
Params <- (Param (',' Param)* ','?)?
Param <- '/' / ('*' / '**')? Id (':' '*'? Expr)? ('=' Expr)? / '*'
Slice <- Named? ':' Expr? (':' Expr?)? / '*' Or / Id (':' Expr)? ('=' Expr)? &(',' / !any) / Named / '**' Id
List <- (Slice CompFor? (',' Slice)* ','?)?
DictE <- '**' Or / '*' Or / Named (':' Expr)?
Dict <- (DictE CompFor? (',' DictE)* ','?)?
"""
INDENT, DEDENT = "\x01in", "\x01out"


@cache
def python() -> Grammar:
    brackets = [
        Bracket("(", ")", ["Args", "Params", "ImpList", "WithL", "PatL"]),
        Bracket("[", "]", ["List"]),
        Bracket("{", "}", ["Dict"]),
        Bracket(INDENT, DEDENT, ["Block", "Cases"], lines=True),
    ]
    classes = {
        "binop": ["//", "%", "&", "^", "<<", ">>"],
        "cmp": ["==", "!=", "<=", ">="],
        "assign": ["+=", "-=", "*=", "/=", "//=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "@="],
    }
    rules = _PY_RULES.replace("('if' Lam* Or ('if' !any)?)*", "('if' Lam* Or)*")
    return Grammar(rules, brackets, classes, newline="\n", statements=("Stmt",), ends=("\n",))


#: Items of lists are no multiple assignments: to look for one from each item on would take quadratic time in long lists.
_RB_RULES = r"""
Top <- Stmts
Sep <- nl / ';'
Term <- Sep+ / !any
Then <- 'then' / Sep+ 'then'? 
Stmts <- Sep* (Stmt (Sep+ / !any / &('elsif' / 'else' / 'when' / 'rescue' / 'ensure')))*
Stmt <- ('BEGIN' / 'END')? Logic (mod Logic / 'rescue' Logic)*
Logic <- 'not'* Expr (('and' / 'or') 'not'* Expr)*
Id <- id
Expr <- MultiL '=' Rhs / Tern ((assign / '=') Rhs)* 
MultiL <- Left (',' Left)+ ','? / '*' Left
Left <- '*'? Un / <Paren>
Rhs <- '*'? Tern ((assign / '=') '*'? Tern)* (',' '*'? Tern)*
Tern <- Range ('?' (Range '?' Range ':' Range / RangeA) ':' RangeA / '?' sym RangeA)*
RangeA <- Range ((assign / '=') Range)*
Range <- Bin (('..' / '...') Bin?)? / ('..' / '...') Bin
BinOp <- binop / '+' / '-' / '*' / '**' / '&' / '|' / '<' / '>' / '/' / '%' / '<<' / '!~'
Bin <- Un (BinOp Un)*
Pre <- '!' / '-' / '+' / '~' / '&' / '**' / '*' / '::' / 'defined?'
Un <- Pre* Prim Post*
Prim <- num / str+ / sym / 'self' / 'nil' / Lambda / 'yield' (<Paren> / CmdArgs)? / 'super' (<Paren> / CmdArgs)? / ('return' / 'break' / 'next') (CmdArgs)? / 'redo' / 'retry' / 'alias' (sym / id / gv / OpM) (sym / id / gv / OpM) / 'undef' (sym / id) (',' (sym / id))* / <DefB> / <ClassB> / <ModB> / <IfB> / <LoopB> / <CaseB> / <BeginB> / Call / gv / <Paren> / <Arr> / <Hash> / '__method__'
Lambda <- '->' (<Paren> / DefParams)? (<BlockB> / <DoB>)
OpM <- binop / '+' / '-' / '*' / '**' / '&' / '|' / '<' / '>' / '/' / '%' / '<<' / '!' / '~' / <Arr> '='? / '+@' / '-@'
Call <- Id ('!' &Stop / '?' &Stop)? (<Paren> Blk? / Blk / CmdArgs Blk?)?
Stop <- nl / ';' / ')' / !any / '.' / <Paren>
Blk <- <BlockB> / <DoB>
Post <- ('.' / '&.') (anyword / OpM / <Paren>) ('!' / '?')? (<Paren> Blk? / Blk / CmdArgs Blk?)? / '::' anyword (<Paren> Blk? / Blk)? / <Arr> / Blk
CmdArgs <- &CmdStart CmdArg (',' nl* CmdArg)*
CmdStart <- id / num / str / sym / gv / label / 'self' / 'nil' / '->' / <Arr0> / 'defined?' / 'not' / '::' id / <DefB> / <IfB> / <CaseB> / <BeginB> / <ClassB> / 'yield' / 'super' / splat / '!' / <NArr>
CmdArg <- (label / str ':' / sym '=>') nl* CmdV / splat? CmdV ('=>' CmdV)? / label
CmdV <- CTern ((assign / '=') CTern)*
CTern <- CRange ('?' CRange ':' CRange)*
CRange <- CBin (('..' / '...') CBin)?
CBin <- CUn (BinOp CUn)*
CUn <- Pre* CPrim CPost*
CPrim <- num / str+ / sym / 'self' / 'nil' / '->' (<Paren> / DefParams)? (<BlockB> / <DoB>) / <DefB> / <IfB> / <CaseB> / <BeginB> / <ClassB> / <LoopB> / Id ('?' / '!')? (<Paren> / CArg1)? / gv / <Paren> / <Arr> / <Hash> / 'yield' <Paren>? / 'super' <Paren>? / '__method__'
CArg1 <- &(id / num / str / sym / gv / label) (label CAtom / splat? CAtom) (',' nl* (label CAtom / splat? CAtom))*
CAtom <- (num / str+ / sym / 'self' / 'nil' / id <Paren>? / gv / <Arr>) CPost*
CPost <- ('.' / '&.') (anyword / <Paren>) ('!' / '?')? (<Paren>)? / '::' anyword <Paren>? / <Arr> / <BlockB>
Arg1 <- (label / str ':') nl* (Stmt)? / splat? Stmt ('=>' Stmt)? / splat
Item <- (label / str ':') nl* (ItemS)? / splat? ItemS ('=>' ItemS)? / splat
ItemS <- ItemL (mod Logic / 'rescue' Logic)*
ItemL <- 'not'* ItemE (('and' / 'or') 'not'* ItemE)*
ItemE <- Tern ((assign / '=') Rhs)*
Paren <- nl* (Item ((',' / Sep)+ Item)* ','? Sep*)? !any / nl* (Arg1 ((',' / Sep)+ Arg1)* ','? Sep*)?
Arr <- nl* (Item (nl* ',' nl* Item)* ','? nl*)?
Arr0 <- 'never'
NArr <- 'never'
Pair <- nl* ((label / str ':') nl* Tern0? / '**' Tern / Tern0 '=>' nl* Tern0) nl*
Tern0 <- CmdNo
CmdNo <- Stmt
Hash <- nl* (Pair (',' Pair)* ','? nl*)?
BParams <- '|' (BParam (',' BParam)* ','? (';' id (',' id)*)?)? '|' / '||'
BParam <- splat? (id ('=' Un)? / label Un? / <Paren>) / splat
BlockB <- nl* BParams? Stmts
DoB <- nl* BParams? Stmts Rescue
Rescue <- ('rescue' RescueL? ('=>' Left)? Then Stmts)* ('else' Stmts)? ('ensure' Stmts)?
RescueL <- '*'? Tern (',' '*'? Tern)*
DefParams <- DefParam (',' nl* DefParam)*
DefParam <- splat? id ('=' Tern)? / label Tern? / splat / '...' / <Paren>
DefB <- (('self' / id) '.')? DName (<Paren> / DefParams)? (Sep+ Stmts Rescue / Stmts Rescue)
DName <- (anyword ('!' / '?')? ('=' &<Paren>)? / OpM)
ClassB <- ('<<' Logic / '::'? id ('::' id)* ('<' Logic)?) Term Stmts Rescue
ModB <- id ('::' id)* Term Stmts
IfB <- Stmt Then Stmts ('elsif' Stmt Then Stmts)* ('else' Stmts)?
LoopB <- (MultiL 'in' / Left 'in')? Stmt Sep+ Stmts
CaseB <- Stmt? Sep* (('when' / 'in') Pat (',' nl* Pat)* ('if' Stmt)? Then Stmts)* ('else' Stmts)?
Pat <- splat? Tern ('=>' id)? / label Tern?
BeginB <- Stmts Rescue
"""
RUBY_MOD = {"if": "if~", "unless": "unless~", "while": "while~", "until": "until~"}


@cache
def ruby() -> Grammar:
    rules = "\n".join(line for line in _RB_RULES.split("\n") if not line.startswith(("Arr0", "NArr"))).replace(" / <Arr0>", "").replace(" / <NArr>", "")
    brackets = [
        Bracket("(", ")", ["Paren"], lines=True),
        Bracket("[", "]", ["Arr"], lines=True),
        Bracket("{", "}", ["Hash", "BlockB"], lines=True),
        Bracket("def", "end", ["DefB"], lines=True),
        Bracket("class", "end", ["ClassB"], lines=True),
        Bracket("module", "end", ["ModB"], lines=True),
        Bracket("if", "end", ["IfB"], lines=True),
        Bracket("unless", "end", ["IfB"], lines=True),
        Bracket("while", "end", ["LoopB"], lines=True),
        Bracket("until", "end", ["LoopB"], lines=True),
        Bracket("for", "end", ["LoopB"], lines=True),
        Bracket("case", "end", ["CaseB"], lines=True),
        Bracket("begin", "end", ["BeginB"], lines=True),
        Bracket("do", "end", ["DoB"], lines=True),
    ]
    classes = {
        "binop": ["^", "||", "&&", ">>", "==", "!=", "===", "<=", ">=", "<=>", "=~"],
        "assign": ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "&&=", "||="],
        "mod": list(RUBY_MOD.values()),
        "sym": [":sym"],
        "label": ["label:"],
        "gv": ["@var"],
        "splat": ["*arg"],
    }
    return Grammar(rules.replace(" ('if' Stmt)? Then", " Then"), brackets, classes, newline="\n", statements=("Stmt",), ends=("\n",))
