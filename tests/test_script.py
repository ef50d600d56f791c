from quarrylane.sources import script

REACT = """
import React from 'react';
// axios.get('/dead')
const URL_SAVE = '/api/order/save';
const Lazy = React.lazy(() => import('./pages/Order'));
function App() {
  const save = async () => { if (mode === 'new') { await axios.post(URL_SAVE, d); } else { navigate('/order/done'); } load(); };
  const load = () => { fetch(`/api/order/${id}`, { method: 'PUT' }); };
  return (<div>
    <Route path="/order/:id" element={<OrderPage />} />
    <Route path={getPath(base, '/lazy')} component={Lazy} />
    <SearchItem label="지역" required><Select name="area" onChange={pick}><Option value="Y">예</Option><Option value="N">아니오</Option></Select></SearchItem>
    <label>이름</label><input id="nm" type="text" required maxLength={10} pattern="[a-z]+" />
    <DatePicker name="day" placeholder="날짜" />
    <Tabs><Tab label="기본" value="1" /><Tab>상세</Tab></Tabs>
    <Button onClick={save}>저장</Button>
    <button onClick={() => { window.open('/help'); }}>도움</button>
    <Button onClick={noop}>없음</Button>
  </div>);
}
const cols = [{ headerName: '번호', field: 'no', editable: true }, { headerName: '사용', field: 'yn', cellRenderer: 'checkboxRenderer', hide: true }];
const schema = yup.object({ nm: yup.string().required('필수').max(10), no: yup.number().min(1) });
const list = [{ path: '/cfg', component: CfgPage }];
function* saga() { const r = yield call(axios.get, '/api/saga/x'); yield call(api.load); }
"""
POLYMER = "customElements.define('my-app', A); Polymer({ is: 'old-el' }); page('/p/list', () => show('list-view'));"
PAGE = """<form action="/order/save.do"><input type="submit" value="저장"/><button type="button" onclick="go()">이동</button></form>
<!-- <a href="/dead.do">x</a> --><a href="/stock/list.do">재고</a><a href="#x">닻</a>
<script>function go(){ location.href = '/main/view.do'; } function f(){ $.ajax({ url : '/ajax/run' }); }</script>
<input type="button" value="실행" onclick="f()"/><span title="검색" onclick="fnSend('/svc/find')"></span>"""


def frame(spark, text):
    return spark.createDataFrame([("a.jsx", text), ("e.jsx", ""), ("n.jsx", None)], "path string, content string")


def test_routes(spark):
    got = {(r["url"], r["component"]) for r in script.route_table(frame(spark, REACT)).collect()}
    assert got == {("/order/{p}", "OrderPage"), ("/lazy", "./pages/Order"), ("/cfg", "CfgPage")}
    assert script.elements(POLYMER) == ["my-app", "old-el"] and script.routes(POLYMER)[0][0] == "/p/list"


def test_api_calls(spark):
    got = {(r["verb"], r["url"]) for r in script.api_table(frame(spark, REACT)).collect()}
    assert got == {("POST", "/api/order/save"), ("PUT", "/api/order/{p}"), ("GET", "/api/saga/x")}


def test_buttons(spark):
    got = [(r["label"], r["step"], r["action"], r["detail"], r["condition"]) for r in script.button_table(frame(spark, REACT)).orderBy("label", "step").collect()]
    assert ("저장", 1, "api", "POST /api/order/save", "mode === 'new'") in got and ("저장", 2, "navigate", "navigate → /order/done", "else") in got
    assert ("저장", 3, "api", "PUT /api/order/{p}", "") in got and ("도움", 1, "navigate", "window.open → /help", "") in got and ("없음", None, None, None, None) in got


def test_spec(spark):
    rows = script.spec_table(frame(spark, REACT)).collect()
    by = {(r["kind"], r["name"], r["label"]): r for r in rows}
    assert by["field", "area", "지역"]["detail"] == "Y, N" and by["field", "area", "지역"]["required"] and by["field", "area", "지역"]["ui_type"] == "select" and by["field", "area", "지역"]["events"] == "onChange"
    assert by["field", "nm", "이름"]["ui_type"] == "text" and by["field", "day", "날짜"]["ui_type"] == "date"
    assert by["grid", "no", "번호"]["detail"] == "E" and by["grid", "yn", "사용"]["detail"] == "H" and by["grid", "yn", "사용"]["ui_type"] == "Checkbox"
    assert {r["label"] for r in rows if r["kind"] == "tab"} == {"기본", "상세"}
    checks = {(r["name"], r["label"], r["detail"]) for r in rows if r["kind"] == "check"}
    assert checks == {("nm", "required", ""), ("nm", "maxLength", "10"), ("nm", "pattern", "[a-z]+"), ("nm", "required", "'필수'"), ("nm", "max", "10"), ("no", "min", "1")}


def test_page_triggers(spark):
    got = {(r["url"], r["label"]) for r in script.trigger_table(frame(spark, PAGE)).collect()}
    assert got == {("/order/save.do", "저장"), ("/main/view.do", "이동"), ("/stock/list.do", "재고"), ("/ajax/run", "실행"), ("/svc/find", "검색")}


def test_broken_and_very_long(spark):
    for bad in ("<", "<a b={", "<Route path=", "function f( {", "a(" * 200, "`", "{" * 5000):
        code = script.uncommented(bad)
        assert script.routes(code) is not None and script.buttons(code) is not None and script.fields(code) is not None
    assert len(script.fields("<input id='a'/>" * 3000)) == 3000
