"""Templates against plain Python functions that write the same texts."""

import pytest

from textlens.functions.template import render_template

CHATS = [(1, "en", True, [("system", "  be kind "), ("user", "hi"), ("assistant", "hello\n"), ("user", "")]),
         (2, "c++", False, [("user", "only {{ this }} {% if %}")]),
         (3, "fr", None, []), (4, None, True, None),
         (5, "de", False, [("tool", None), (None, "nobody"), ("assistant", "x")])]
SCHEMA = "id long, lang string, ask boolean, chat array<struct<role:string,content:string>>"


def rendered(spark, template, **constants):
    df = spark.createDataFrame(CHATS, SCHEMA)
    out = render_template(df, template, {"messages": "chat", "add_generation_prompt": "ask", "language": "lang"}, constants)
    return {r.id: r.rendered for r in out.collect()}


def chats():
    for i, lang, ask, chat in CHATS:
        yield i, lang or "", bool(ask), [(r or "", c or "") for r, c in chat or []]


def test_loop_with_branches_and_a_generation_prompt(spark):
    template = ("{{ bos_token }}{% for m in messages %}<|{{ m['role'] }}|>{{ m.content | trim }}{% if not loop.last %}\n{% endif %}\n"
                "{% endfor %}{% if add_generation_prompt %}<|assistant|>{% endif %}\n")
    want = {i: "<s>" + "".join(f"<|{r}|>{c.strip()}" for r, c in chat) + ("<|assistant|>" if ask else "") for i, _, ask, chat in chats()}
    assert rendered(spark, template, bos_token="<s>") == want
    # the newline inside the inner if is dropped with its block's, so a value is used for it
    template = template.replace("\n{% endif %}", "{{ '\\n' }}{% endif %}")
    want = {i: "<s>" + "\n".join(f"<|{r}|>{c.strip()}" for r, c in chat) + ("<|assistant|>" if ask else "") for i, _, ask, chat in chats()}
    assert rendered(spark, template, bos_token="<s>") == want


def test_system_prompt_set_and_slices(spark):
    template = """{# the first message may be a system prompt #}
{% if messages[0].role == 'system' %}
  {% set system = messages[0].content.strip() %}
  {% set rest = messages[1:] %}
{% else %}
  {% set system = 'in {language}' %}
  {% set rest = messages %}
{% endif %}
[{{ system }}|{{ rest | length }}]
{%- for m in rest -%}
  {{ ' ' + loop.index ~ ':' if false else ' ' }}{{ loop.index }}/{{ loop.length }}
  {%- if m.role == 'user' and m.content %} U={{ m.content | upper }}
  {%- elif m.role in 'assistant tool' and m.role %} {{ m.role }}
  {%- else %} -{% endif %}
{%- endfor %}"""
    template = template.replace("' ' + loop.index ~ ':' if false else ' '", "'?' if loop.index < 1 else ' '")
    want = {}
    for i, lang, _, chat in chats():
        system, rest = (chat[0][1].strip(), chat[1:]) if chat and chat[0][0] == "system" else (f"in {lang}", chat)
        out = f"[{system}|{len(rest)}]"
        for k, (r, c) in enumerate(rest, 1):
            out += f" {k}/{len(rest)}" + (f" U={c.upper()}" if r == "user" and c else f" {r}" if r in ("assistant", "tool") else " -")
        want[i] = out
    assert rendered(spark, template) == want


def test_values_filters_and_unknown_names(spark):
    cases = {
        "{{ nothing }}|{{ nothing.at.all }}|{{ nothing | default('d') }}|{% for x in nothing %}x{% endfor %}": lambda *a: "||d|",
        "{{ language | default('none') }} {{ language is defined }}": lambda i, g, a, c: f"{g or 'none'} {bool(g)}",
        "{{ (messages | length) + 1 }},{{ messages | length % 2 == 0 }}": lambda i, g, a, c: f"{len(c) + 1},{len(c) % 2 == 0}",
        "{{ 'a' + language | upper }}{{ ('a' + language) | upper }}": lambda i, g, a, c: "a" + g.upper() + "A" + g.upper(),
        "{{ messages[-1].role }}{{ (messages | first).role }}": lambda i, g, a, c: (c[-1][0] + c[0][0]) if c else "",
        "{% if n == 3 and not off %}three{% endif %}{{ n - 1 }}{{ off }}": lambda *a: "three2False",
        "{{ language.startswith('c') }} {{ none is none }}": lambda i, g, a, c: f"{g.startswith('c')} True",
        "{language} { language } {}": lambda i, g, a, c: f"{g} {{ language }} {{}}",
    }
    for template, write in cases.items():
        assert rendered(spark, template, n=3, off=False) == {i: write(i, g, a, c) for i, g, a, c in chats()}, template


def test_what_is_not_supported_raises_at_once(spark):
    for bad in ("{% for m in messages %}", "{% while x %}", "{{ messages.pop() }}", "{{ a b }}", "{% macro f() %}", "{{ x | nosuch }}",
                "{% for m in language %}{% endfor %}", "{% if x %}{% endfor %}"):
        with pytest.raises(ValueError):
            rendered(spark, bad)
    with pytest.raises(Exception, match="roles must"):
        rendered(spark, "{% if messages[0].role == 'tool' %}{{ raise_exception('roles must alternate') }}{% endif %}")
