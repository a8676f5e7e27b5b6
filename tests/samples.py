"""A small corpus of sources with known properties, for queries and tests: (codebase, path, lang, source)."""

JAVA = {
    "cc_branchy": ("A.java", 'class A { int f(int a, boolean b) {\n  if (a > 0 && b) { a++; }\n  for (int i = 0; i < a; i++) { a += i; }\n  return b ? a : 0;\n} }'),
    "cc_switch": ("B.java", "class B { int f(int a) {\n  switch (a) {\n    case 1: return 1;\n    case 2: return 4;\n    case 3: return 9;\n    default: return 0;\n  }\n} }"),
    "cc_catch": ("C.java", "class C { void f() {\n  try { g(); } catch (IllegalStateException e) { h(); } catch (RuntimeException e) { h(); }\n} void g() {} void h() {} }"),
    "cc_mean": ("D.java", "class D { int one() { return 1; }\n int two(int a) { if (a > 0) { return a; } return 0; } }"),
    "cog_if": ("E.java", "class E { void f(int a) { if (a > 0) { g(); } } }"),
    "cog_ifelse": ("F.java", "class F { void f(int a) { if (a > 0) { g(); } else { h(); } } }"),
    "cog_elif": ("G.java", "class G { void f(int a) { if (a > 0) { g(); } else if (a < 0) { h(); } } }"),
    "cog_elif_else": ("H.java", "class H { void f(int a) { if (a > 0) { g(); } else if (a < 0) { h(); } else { k(); } } }"),
    "cog_nested": ("I.java", "class I { void f(int a) { if (a > 0) { if (a > 9) { g(); } } } }"),
    "cog_and": ("J.java", "class J { void f(boolean a, boolean b, boolean c) { if (a && b && c) { g(); } } }"),
    "cog_mixed": ("K.java", "class K { void f(boolean a, boolean b, boolean c) { if (a && b || c) { g(); } } }"),
    "cog_recursion": ("L.java", "class L { int fact(int n) { if (n < 2) { return 1; } return n * fact(n - 1); } }"),
    "rfc_a": ("M.java", 'class M { void a() { System.out.println("x"); } void b() { helper(); } void c() {} }'),
    "dit_chain": ("N.java", "class Root {} class L1 extends Root {} class L2 extends L1 {} class L3 extends L2 {}"),
    "dit_ext": ("O.java", "class O extends RuntimeException {}"),
    "mhf_mix": ("P.java", "class P1 { public void a() {} void b() {} } class P2 { private void a() {} private void b() {} public void c() {} }"),
    "cbo_hub": ("Q.java", "class Q { Alpha a; Beta b; Gamma c; String s; int n; }"),
    "cbo_mean": ("R.java", "class R1 { Alpha a; Beta b; } class R2 { int n; }"),
    "lcom_one": ("S.java", "class S { int x; int a() { return x; } int b() { return this.x + 1; } }"),
    "lcom_two": ("T.java", "class T { int x, y; int a() { return x; } int b() { return x; } int c() { return y; } int d() { return y; } }"),
    "lcom_single": ("U.java", "class U { int x; int a() { return x; } }"),
    "lcom_noshare": ("V.java", "class V { int x, y; int a() { return x; } int b() { return y; } int c() { return 1; } }"),
    "lcom_isolated": ("W.java", "class W { int x; int a() { return x; } int b() { return x; } int c() { return 1; } }"),
    "doc_full": ("X.java", "/** Doc. */\npublic class X {\n  /** Doc. */\n  public void a() {}\n}"),
    "doc_part": ("Y.java", "/** Doc. */\npublic class Y {\n  /** Doc. */\n  public void a() {}\n  public void b() {}\n}"),
    "sec_hash_cmd": ("Z.java", 'class Z { void f(String p) throws Exception { java.security.MessageDigest.getInstance("MD5"); Runtime.getRuntime().exec("ls " + p); } }'),
    "sec_sql": ("Sa.java", 'class Sa { void f(java.sql.Statement s, String id) throws Exception { s.executeQuery("select * from t where id = " + id); } }'),
    "sec_random": ("Sb.java", "class Sb { int f() { return new java.util.Random().nextInt(); } }"),
    "sec_xxe": ("Sc.java", "class Sc { void f() throws Exception { DocumentBuilderFactory.newInstance().newDocumentBuilder(); } }"),
    "smell_params": ("Sd.java", "class Sd { void f(int a, int b, int c, int d, int e, int g) {} }"),
    "tsmell": ("SeTest.java", "class SeTest { @Test void empty() { int a = 1; } @Test void sleepy() throws Exception { Thread.sleep(5); assertTrue(true); } }"),
    "bad_file": ("Bad.java", "class { not java"),
}
KOTLIN = {
    "kt_ab": ("A.kt", "fun a(x: Int): Int = if (x > 0) 1 else 2\n\nfun b(x: Int): Int {\n  return if (x > 1) x else 0\n}\n"),
    "kt_service": ("S.kt", "open class Base\nclass Service : Base() {\n  fun a() = 1\n  private fun b() = 2\n  fun c() = 3\n}\n"),
}


def rows() -> list[tuple[str, str, str, str]]:
    out = [(k, f"src/main/java/{p}", "java", s) for k, (p, s) in JAVA.items()]
    return out + [(k, f"src/main/kotlin/{p}", "kotlin", s) for k, (p, s) in KOTLIN.items()]


SCHEMA = "codebase string, path string, lang string, source string"
