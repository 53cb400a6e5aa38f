"""Sentences with labelled personal details, composed at random for training and for held-out tests of the tagger.

Names are drawn from the lists of the package (docloom/llm/data/names.txt) and composed, numbers and addresses by
rule, sentences from parts. The held-out share of the names and the held-out parts occur in no training sentence.
"""

from __future__ import annotations

import random

from docloom.llm.pii import lists

Span = tuple[int, int, int]
#: Every so many entries of a list one is held out, but none of the most common names, which begin the lists.
HELD, COMMON = 10, {"family": 60, "given": 100, "first": 40, "last": 40}

ZH_BEFORE = """经办人| 经办人：|联系人：|联系人 |申请人|负责人：|签收人|姓名：|我是|我叫|请找|请联系|联系|通知|昨天|今天上午|上周五|会上，|据|与|和|由|让|把文件交给|材料已转交|合同由|替|代表|感谢|同事|工程师|经理|主任|医生|老师|客户|患者|乙方代表|收件人：|收货人 |寄给|抄送|此事由|主讲人：|作者：|审核：|审批人：|记录人：|监护人|法定代表人：|项目组的|财务部|人事部|我和|其中|包括|另有|到场的有|面试了|任命|录用|邀请|采访了|致电|陪同|嘉宾|选手|学生|家属|邻居|司机|会计|护士|律师|研究员|尊敬的|亲爱的|你好，|您好，|早上|下午三点，|本周|随后|最后|因为|如果|虽然|但是|据悉，|会议由|报告由|问题由|请把钥匙交给|车主|房东|租客|投诉人|举报人|证人|被告|原告|受益人：|投保人：|持卡人|户名：|开户人|发件人：|编辑|摄影：|导演|演员|歌手|队长|厂长|村民|业主|店主|老板|校长|院长|班长|同学|战友|表哥|叔叔|女儿|儿子|妻子|丈夫|母亲|父亲|助理|秘书|出纳|保安|保洁员|快递员|业务员|调度员|检验员|操作工|电工|焊工|组长|科长|处长|局长|部长|主席|书记|委员|专家|顾问的|代理人|担保人|承办人|经手人|核对人|复核人：|校对：|制表：|发起人|参会人：|主持人|记者|作家|画家|教练|裁判|球员|患儿|孕妇|伤者|目击者|受访者|被访者|求职者|应聘者|候选人|毕业生|新员工|实习生|退休职工|前任|现任|继任者|创始人|股东|董事|监事|合伙人|投资人|债权人|债务人|出租方：|承租方：|买方：|卖方：|他叫|她叫|名叫|我爸|我妈|这位是|那位是|听|看见|遇到|认识|拜访|接待|护送|带着|跟着|委托|授权|安排|要求|建议|表扬|批评|处罚|奖励""".split("|")
ZH_AFTER = """先生|女士|小姐|老师|同学|经理|主任|医生|教授|律师|工程师|会计|负责落实|已提交材料|提出异议|的申请|问一下|说|表示|认为|介绍|指出|强调|回答|来电|来访|到场|出席|请假|离职|入职|签字|签收|确认|审批通过|不同意|同意了|负责|负责这个项目|正在开会|住在上海|毕业于北京|去了广州|今年三十岁|的电话|的合同|的账号|的手机号|的工资|的孩子|的报告|写的报告|参加了会议|主持会议|，|。|：|；|（男）|（女，35岁）|(财务部)|、| 收| 敬上|等人|和家人|与客户|在会上发言|将于明天到达|没有来|已经到了|刚刚离开|是新来的|是谁|在吗|您好|你好|打来电话|发来邮件|取走了包裹|完成了测试|买了票|的简历很好|的护照过期了|因病住院|获得一等奖|担任队长|接任|调往总部|被任命为主任|曾在银行工作|手机|，电话|，手机|，身份证|/|——|”|》|》一书|先生/女士|的父亲|的妹妹|说他明天不能来|说她不同意|一起吃了晚饭|一起去的|去医院复查了|明天出差|昨天没来上班|正在等您|想请假|要求退款|提出了建议|完成签字|会按时完成|表示会按时到|推进|牵头|签字确认|写道|告诉我|让我转告|发现了问题|已经离职|不在办公室|在楼下|还没回复|又来了|刚打过电话|把钥匙带走了|是我的同事|跟我说过|向公司申请|对此负责|为主讲人|从北京来|被评为先进|，男，1988年生|（手机|：好的|回复：同意|""".split("|")
EN_BEFORE = """Contact person: |Contact: |Please contact |Please ask |Ask for |signed by |Signed by |on behalf of |The meeting was led by |Yesterday |Today |Last week |According to |Dear |Hi |Thanks, |I am |My name is |This is |Mr |Mr. |Mrs |Ms |Ms. |Dr |Dr. |Prof. |our colleague |our manager |the engineer |the customer |the patient |Attn: |Attention: |Name: |Author: |Reviewed by |Approved by |Prepared by |Speaker: |written by |sent to |sent by |from |with |for |by |between |and |cc |Invoice for |The order of |A letter from |I spoke with |She met |He called |They hired |We interviewed |We thank |Call |Email |Tell |Remind |accountant |driver |nurse |Professor |Captain |Director |Patient |Employee: |Tenant: |Owner: |Beneficiary: |Cardholder |In May |However, |Later |Finally, |Then |When |Because |If |Although |Both |a call from |met |thanked |invited |hired |visited |helped |followed |our guest |the tenant |the witness |the author |the nurse |neighbour |teacher |supervisor |Judge |Coach |Sir |Lady |Sergeant |Officer |Recipient: |Sender: |Applicant: |Student: |Guest: |Reviewer: |Witness: |Landlord: |Doctor: |Requested by |Submitted by |Handled by |Led by |Hosted by |Introduced by |a talk by |a book by |a visit by |notes from |next to |near |without |about |Meet |See |Ask |Find |Hello |Hey |So |Now |Also |Sadly |Luckily |Meanwhile |Afterwards |On Friday |In Berlin |At noon """.split("|")
EN_AFTER = """ approved the plan| signed the form| called back| will attend| left early| has not replied| asked for a copy| last visited on Monday| is the contact| is our new engineer| lives nearby| moved to Berlin| wrote the report| joined the team| was absent| paid the bill| opened the account| reviewed it|'s order|'s phone|'s contract|'s office|, manager|, 34,|, CEO of the firm,| (Finance)| and others| said so| agreed| resigned| won the prize|,|.|:|;| <| -| /|?|!| from accounting| in person| at noon| by phone| about the invoice| before Friday|, please call back|, who lives here,|. What does it say|. Please reply|: Which rule applies| for the order| called.| phoned twice| speaking| was great| at the fair| gave a talk| sent this| has the key|. Can you help| wants a refund| needs help| will sign|; the rest left""".split("|")
DE_BEFORE = """Ansprechpartner: |Ansprechpartner |Ansprechpartnerin |Herr |Herrn |Frau |Für |Von |An |Mit |Kontakt: |Name: |Ich bin |Mein Name ist |Gestern hat |Heute |Laut |Bitte |Bitte an |unterschrieben von |im Auftrag von |Der Kunde |Die Kundin |unser Kollege |unsere Kollegin |Sehr geehrter Herr |Sehr geehrte Frau |Liebe |Lieber |Dr. |Prof. |geleitet von |geprüft von |Autor: |Mieter: |Patient |Fahrer |Buchhalterin |Danach |Zuletzt |Weil |Wenn |Dann |und |oder |Mitarbeiter: |Bitte rufen Sie Frau |Bitte rufen Sie Herrn |Rufen Sie |Fragen Sie |Danke an |Gruß an |Termin mit |Gespräch mit |Vortrag von |Buch von |Geschäftsführer |Ingenieurin |Lehrer |Ärztin |Nachbar |Zeuge |Zeugin |Gestern kam |Leider ist |Auch |Zum Glück hat |Eingereicht von |betreut von |Vermieter: |Empfänger: |Absender: """.split("|")
DE_AFTER = """ hat unterschrieben| unterschrieb gestern| hat angerufen| kommt morgen| ist krank| wohnt in Köln| bittet um Rückruf| leitet das Projekt| war nicht da| prüft den Antrag| schrieb den Bericht| hat gekündigt| ist Ansprechpartner| fragt nach|, Leiter Einkauf,|,|.|:|;| und andere| aus der Buchhaltung| sagte zu|?|!|: Welche Regel gilt|. Wer prüft das|. Bitte melden| ist dran| meldet sich| hat zugestimmt| unterschrieb| an|. Die Lieferung kommt""".split("|")

# Sentences without a detail, many with words that begin like a name.
ZH_NONE = """高度重视安全生产|马上处理这个问题|方法简单可行|金额以合同为准|张贴在公告栏|黄色标签表示注意|周期为三个月|周末不上班|石油价格上涨|白天施工晚上停工|常见问题解答|万元以上需审批|任务完成情况|江苏省的客户|安全检查记录|温度超过上限|平方米计算|程序运行正常|成功提交申请|时间安排如下|于是停止运行|向下调整指标|余额不足|连接超时|文件已归档|高速公路入口|林业部门批准|谢谢您的支持|许可证到期|何时可以取货|曾经发生故障|田地面积|董事会决议|方面的要求|陈述理由|陈列柜损坏|段落格式|孔隙率偏大|毛巾和水杯|钱包丢失|易于维护|严格执行规定|武汉分公司|古代建筑|单位名称|车间主任签字|房屋租赁|路线规划|左侧通道|季度报表|关闭阀门|关于设备的说明|解决方案|安装调试|康复中心|乐观估计|温控系统|柯达胶卷|顾客投诉|顾问意见|沈阳仓库|罗列如下|黎明时分|雷雨天气|龙头漏水|史料整理|陶瓷工厂|贺卡样品|郑州门店|宋体小四|唐山分部|韩国进口|冯氏公司|邓小路|曹操故事|彭城路口|肖像权|袁州区|潘家园|蒋村站|蔡家坡|杜绝浪费|叶片磨损|苏州园区|魏都大厦|吕梁地区|丁字路口|姚家镇|卢浮宫|姜汁饮料|崔家沟|钟表维修|谭家岭|陆续到货|汪洋大海|范围之内|廖廖无几|贾汪区|夏季用电|韦恩图|付款方式|邹城市|孟加拉国|熊猫图案|秦皇岛港|邱隘镇|尹家峪|薛家湾|侯马市|向量计算|施工期限|喻体与本体|华东地区|葛根粉|俞家桥|柳州工厂|鲁班尺|苗木采购|王府井大街店|李子熟了|刘家峡水库|杨树种植|赵州桥|吴江区|徐州站|孙子兵法|朱红色|胡同口|郭家村|甲方负责支付|乙方应当在七日内答复|质量部|采购部已确认|总经理办公室|客服中心|项目经理需签字|本公司有权|该设备型号|华为手机|小米电视|中国银行|北京大学出版社|人民医院|请技术员检查|由物业公司负责|值班人员记录|订单已发货|会议纪要|附件一|全体员工|各部门|第三方检测机构|国家标准|上海证券交易所|安装位置在二楼|高新技术企业|万能胶|方便面|水杯|金属板|白色外壳|黄河流域|江河湖海|任何单位|和平方式|明确责任|明显改善|国家规定|建设单位|志愿者|文明施工|海外市场|平台升级|新华书店|长江大桥|东方明珠|上官桥镇|欧阳路口""".split("|")
EN_NONE = """Please read the User Manual first.|The Board of Directors met.|New York is large.|Open the Control Panel and select Settings.|Monday Morning Briefing|Quality Assurance Department|Annual Report of the Company|The Random House edition|See Section Two below.|United Kingdom office|Green Valley Logistics Ltd delivered late.|Human Resources will reply.|Customer Service is open.|The Project Manager must sign.|Standard Operating Procedure|Version Control System|Chief Executive Officer|Terms and Conditions apply.|North Sea Port|Delivery Note enclosed|Black Friday offers|Microsoft Excel file|Safety First|Invoice Number follows|Supreme Court ruling|Red Cross volunteers|World Health Organization|Data Protection Act|Spare Parts Catalogue|Blue Ridge Foods Inc|Main Street is closed.|Warehouse Seven is full.|Ask the Help Desk.|Dear Customer, thank you.|Dear Sir or Madam,|Air Traffic Control|Regards, Support Team|The Nordic Bank|Saint Petersburg plant|Hard Drive failure|San Francisco branch|Los Angeles depot|South Wing entrance|My Passport is old.|Please Note the change.|Given Module four|Which Sensor failed?|What Happens Next|Our Office Hours|The Finance Team|Primary Valve Assembly""".split("|")
DE_NONE = """Die Deutsche Bahn fährt wieder.|Bitte das Formblatt ausfüllen.|Sehr geehrte Damen und Herren,|Der Projektleiter prüft den Antrag.|Guten Tag,|Die Stadt Köln baut um.|Allgemeine Geschäftsbedingungen gelten.|Mit freundlichen Grüßen|Das Technische Hilfswerk kommt.|Die Firma Nordlicht GmbH liefert.|Kleine Pumpe Große Wirkung|Der Vorstand tagt Montag.|Erste Hilfe Kasten|Das Rote Kreuz hilft.|Die Neue Halle öffnet.|Anlage Nord Abschnitt Süd|Der Betriebsrat stimmt zu.|Neue Zeitung|Mein Ausweis ist abgelaufen.|Meine Nummer ist neu.|Ihr Vertrag läuft aus.|Unsere Adresse stimmt.|Welche Pumpe läuft?|Wer Post bringt|Die Glatte Vorlage|Das Enge Lager Nord|Frankfurter Allee Süd ist gesperrt.|Rechnung folgt.|Kalte Quelle Breite Mühle""".split("|")
NOISE = ("订单编号 DD-{n8}", "合同编号 HT{n12}", "版本 {v} 已发布", "{y}年{m}月{d}日", "{y}-{m2}-{d2}", "共{n3}元", "单号{n12}", "Ticket {n9} is closed", "Order No. {n10}", "Invoice {n6}-{n4}", "ISBN 978-7-{n4}-{n4}-1", "IP 192.168.{n2}.{n2}", "serial {A2}{n8}", "Vorgang {n12} ist beendet", "Rechnung {n8}", "Artikel {n5}-{n3}", "金额{n4}.{n2}元", "总计 {n3},{n3}.00", "型号{A2}-{n4}", "条码{n12}", "page {n2} of {n3}", "{n2}:{n2}:{n2}", "批次{n8}", "流水号：{n16}", "税率{n2}%", "build {v}", "房间{n3}", "room {n3}", "{n3} units", "sku {A2}{n6}{A2}", "快递单号SF{n12}", "邮编{n6}", "工号{n5}", "卡号尾号{n4}", "charge {n4} kWh", "v{v}", "the {A2}-{n5} roster", "{A2}-{n4} 已归档", "部件{A2}-{n5}", "hash 4cb9f{n12}e7{n5}ab", "{n6}c{n8}f{n4}", "Teil {A2}-{n5}", "id {n8}a{n6}")


def _split(xs: list[str], held: bool, common: int = 0) -> list[str]:
    return [x for i, x in enumerate(xs) if (i % HELD == HELD - 1 and i >= common) == held]


class Composer:
    """Random labelled sentences; ``held`` ones use only the held-out names and sentence parts."""

    def __init__(self, seed: int, held: bool = False) -> None:
        self.rng, lex = random.Random(seed), lists()
        self.names = {k: _split(v, held, COMMON.get(k, 0)) if k != "compound" else v for k, v in lex.items()}
        self.parts = {n: _split([p for p in globals()[n] if p], held) for n in ("ZH_BEFORE", "ZH_AFTER", "EN_BEFORE", "EN_AFTER", "DE_BEFORE", "DE_AFTER", "ZH_NONE", "EN_NONE", "DE_NONE")}

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    # ---- details ----
    def name_zh(self) -> str:
        r = self.rng
        family = r.choice(self.names["compound"]) if r.random() < 0.06 else r.choice(self.names["family"])
        given = "".join(r.choice(self.names["given"]) for _ in range(1 if r.random() < 0.3 else 2))
        return family + (given[0] * 2 if len(given) == 2 and r.random() < 0.08 else given)

    def _syllables(self, n: int) -> str:
        r = self.rng
        return "".join(r.choice(["b", "br", "c", "d", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "qu", "r", "s", "sh", "st", "t", "th", "v", "w", "z"]) + r.choice("aeiou") + r.choice(["", "", "l", "n", "r", "s", "m", "t"]) for _ in range(n)).capitalize()

    def name_latin(self) -> str:
        r = self.rng
        first = r.choice(self.names["first"]) if r.random() < 0.8 else self._syllables(2)
        last = r.choice(self.names["last"]) if r.random() < 0.6 else self._syllables(r.choice([2, 2, 3])) + r.choice(["", "", "son", "ton", "ley", "worth", "moor", "mann", "berg", "ski", "ova", "dale", "stead", "gate", "wick", "ham", "port", "bury", "field", "feld", "ford"])
        if r.random() < 0.06:
            last += "-" + r.choice(self.names["last"])
        x = r.random()
        middle = f" {r.choice('ABCDEFGHIJKLMNOPRSTVW')}." if x < 0.25 else f" {r.choice(self.names['first'])}" if x < 0.28 else r.choice([" von", " de", " van der"]) if x < 0.31 else ""
        return f"{first}{middle} {last}"

    def phone(self) -> str:
        r, d = self.rng, self.digits
        forms = (
            lambda: "1" + r.choice("3456789") + d(9), lambda: f"1{r.choice('3456789')}{d(1)} {d(4)} {d(4)}", lambda: f"1{r.choice('3456789')}{d(1)}-{d(4)}-{d(4)}", lambda: f"+86 1{r.choice('3456789')}{d(9)}", lambda: f"+86-1{r.choice('3456789')}{d(9)}", lambda: f"0{d(2)}-{d(8)}", lambda: f"0{d(3)}-{d(7)}", lambda: f"(0{d(2)}) {d(4)} {d(4)}", lambda: f"(0{d(2)}){d(8)}",
            lambda: f"(505) 555 0{d(3)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+1 {d(3)} {d(3)} {d(4)}", lambda: f"+1-{d(3)}-{d(3)}-{d(4)}", lambda: f"+44 20 {d(4)} {d(4)}", lambda: f"020 {d(4)} {d(4)}", lambda: f"+44 7{d(3)} {d(6)}",
            lambda: f"+49 30 {d(6)}", lambda: f"030/{d(7)}", lambda: f"030 {d(5)}-{d(3)}", lambda: f"+49 {d(3)} {d(5)}-{d(3)}", lambda: f"(030) {d(5)}-{d(2)}", lambda: f"+33 {r.choice('12345')} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(3)} {d(6)}",
        )
        out = r.choice(forms)()
        return out.translate({i: i + 0xFEE0 for i in range(48, 58)}) if r.random() < 0.06 and out.isdigit() else out

    def email(self) -> str:
        r = self.rng
        word = lambda: r.choice([self._syllables(r.choice([1, 2, 3])).lower(), r.choice(self.names["first"]).lower(), r.choice(self.names["last"]).lower().replace("'", "")])
        local = r.choice([".", "_", "-", "", "+"]).join(word() for _ in range(r.choice([1, 2, 2, 3]))) + r.choice(["", "", self.digits(2), self.digits(4)])
        if r.random() < 0.04:
            local = ".".join(word() + self.digits(r.choice([0, 3])) for _ in range(r.choice([8, 14, 20])))
        local = "".join(c for c in local if c.isascii() and (c.isalnum() or c in "._+-")) or "info"
        at = r.choice(["@"] * 8 + [" (at) ", " [at] ", " at ", "(at)", " AT "])
        host = r.choice([word(), word() + "-" + word(), "mail." + word()])
        host = "".join(c for c in host if c.isascii() and (c.isalnum() or c in "-.")) or "example"
        end = r.choice([".com", ".cn", ".de", ".org", ".example", ".test", ".co.uk", ".net", ".io"])
        return local + at + host + (end.replace(".", r.choice([" dot ", "."])) if at.strip() != "@" else end)

    def identity(self) -> str:
        r, d = self.rng, self.digits
        birth = f"{r.randrange(1940, 2015)}{r.randrange(1, 13):02d}{r.randrange(1, 29):02d}"
        tail = d(3) + r.choice("0123456789X")
        return r.choice([lambda: d(6) + birth + tail, lambda: d(6) + birth + tail, lambda: f"{d(6)} {birth} {tail}", lambda: f"{d(6)}-{birth}-{tail}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: self._code(), lambda: self._code()])()

    def _code(self) -> str:
        r = self.rng
        out = r.choice("ABCDEFGHJKLMNPRTUVWXYZ") + "".join(r.choice("0123456789CFGHJKLMNPRTVWXYZ") for _ in range(8))
        return out if any(c.isdigit() for c in out) else out[:-2] + self.digits(2)

    def address(self) -> str:
        r, d = self.rng, self.digits
        han = lambda n: "".join(r.choice("东西南北中新华文明和平长安建设解放人民光复兴海江河山湖林泉石金银松柏桃梅兰竹菊鹤云龙凤虹星月阳春秋福康永乐清远宁静石桥塘口浦湾岭谷") for _ in range(n))
        if r.random() < 0.5:
            place = r.choice(["", han(2) + "市", han(2) + "省" + han(2) + "市", han(2) + "市" + han(2) + "区", han(2) + "区", han(2) + "县" + han(2) + "镇"])
            return place + han(2) + r.choice(["路", "街", "大道", "巷", "胡同", "弄"]) + str(r.randrange(1, 2000)) + "号" + r.choice(["", "", f"{d(1)}号楼{d(3)}室", f"{r.randrange(1, 30)}栋{d(3)}室", f"{d(1)}单元{d(3)}", f"{r.randrange(1, 30)}楼", f"院{r.randrange(1, 9)}号楼"])
        town = r.choice([self._syllables(2), self._syllables(2) + r.choice(["ton", "ford", "worth", "burg", "stadt", "dorf", "ville"])])
        if r.random() < 0.5:
            street = self._syllables(2) + r.choice(["", "ridge", "field", " Hill", " Park"])
            return f"{r.randrange(1, 999)} {street} {r.choice(['Street', 'Road', 'Lane', 'Avenue', 'Drive', 'Court', 'Way', 'Place', 'Close', 'St', 'Rd'])}, {town}" + r.choice(["", "", f" {d(5)}", f", {r.choice(['CA', 'NY', 'TX', 'WA'])} {d(5)}"])
        return f"{self._syllables(2)}{r.choice(['straße', 'weg', 'gasse', 'allee', 'platz', 'ring'])} {r.randrange(1, 300)}{r.choice(['', '', 'a', 'b'])}, {d(5)} {town}"

    def detail(self, kind: int, lang: str) -> str:
        if kind == 0:
            return self.name_zh() if lang == "ZH" and self.rng.random() < 0.93 else self.name_latin()
        return (self.phone, self.email, self.identity, self.address)[kind - 1]()

    def noise(self) -> str:
        r, d = self.rng, self.digits
        out = r.choice(NOISE)
        for k in (16, 12, 10, 9, 8, 6, 5, 4, 3, 2):
            while f"{{n{k}}}" in out:
                out = out.replace(f"{{n{k}}}", d(k), 1)
        while "{A2}" in out:
            out = out.replace("{A2}", "".join(r.choice("ABCDEFGHKLMNPQRSTUVWXYZ") for _ in range(2)), 1)
        return out.format(v=f"{r.randrange(20)}.{r.randrange(60)}.{r.randrange(200)}" + r.choice(["", f".{r.randrange(200)}"]), y=r.randrange(1990, 2030), m=r.randrange(1, 13), d=r.randrange(1, 29), m2=f"{r.randrange(1, 13):02d}", d2=f"{r.randrange(1, 29):02d}")

    # ---- sentences ----
    _CUES = {
        1: ("电话", "电话：", "手机", "手机号", "请拨打", "致电", "tel ", "Call ", "phone: ", "Telefon ", "unter ", "，", "（", "联系方式：", "Fax: ", "回电请打"),
        2: ("邮箱", "邮箱：", "发送到", "email ", "Write to ", "E-Mail: ", "an ", "（", "，", "mail: ", "请发至"),
        3: ("身份证", "身份证号：", "证件号", "证件号码为", "护照号", "ID ", "ID number ", "identity number ", "Identity No. ", "passport ", "social security number ", "Ausweis ", "Mein Ausweis ist ", "Personalausweis: ", "SSN ", "Ausweis ", "identity ", "，", "证号"),
        4: ("地址", "地址：", "现住", "寄往", "送到", "住在", "lives at ", "Deliver to ", "Anschrift: ", "wohnt ", "位于", "address: "),
    }

    def sentence(self) -> tuple[str, list[Span]]:
        r = self.rng
        lang = r.choices(["ZH", "EN", "DE"], [5, 3, 2])[0]
        text, spans = "", []

        def put(value: str, kind: int) -> None:
            nonlocal text
            spans.append((len(text), len(text) + len(value), kind))
            text += value

        for _ in range(r.choice([1, 1, 2, 3])):
            what = r.random()
            if what < 0.02 and lang != "ZH":  # a first name alone is no whole name, nor with the word before it
                text += r.choice(["Yesterday ", "Today ", "Maybe ", "Then ", "Later ", "Gestern ", "Heute ", "Vielleicht "]) + r.choice(self.names["first"]) + r.choice([" called. ", " left. ", " agreed. ", " ging. "])
                continue
            if what < 0.30:
                text += r.choice(self.parts[f"{lang}_NONE"]) + r.choice(["，", "。", ""] if lang == "ZH" else [" ", ". "])
                continue
            if what < 0.36:
                text += self.words(lang, r.choice([2, 4, 6])) + self._mark(text, lang)
                continue
            if what < 0.42:
                text += self.noise() + r.choice(["，", "。"] if lang == "ZH" else [". ", ", "])
                continue
            if what < 0.78:
                free = r.random()  # words at random before or behind the name, or parts
                before = self.words(lang, r.choice([1, 2, 3])) + " " * (lang != "ZH") if free < 0.3 else r.choice(self.parts[f"{lang}_BEFORE"]) if r.random() < 0.8 else ""
                if lang != "ZH" and text and not text.endswith((" ", "\n")):
                    text += " "
                text += before
                put(self.detail(0, lang), 0)
                if r.random() < 0.15:
                    for _ in range(r.choice([1, 2])):
                        text += r.choice(["、", "，", "和", "与"] if lang == "ZH" else [", ", " and ", " & "])
                        put(self.detail(0, lang), 0)
                if 0.2 < free < 0.55:
                    text += " " * (lang != "ZH") + self.words(lang, r.choice([1, 2, 3, 4]), False)
                else:
                    text += r.choice(self.parts[f"{lang}_AFTER"])
            else:
                kind = r.choice([1, 1, 2, 3, 4])
                text += r.choice(self._CUES[kind]) + r.choice(["", "", " "])
                put(self.detail(kind, lang), kind)
                text += r.choice(["。", "，", "", "已登记。", "收不到通知，"] if lang == "ZH" else [". ", ", ", "", " is wrong. "])
            if r.random() < 0.25:
                text += self._mark(text, lang) + r.choice(self.parts[f"{lang}_NONE"])
            text += self._mark(text, lang)
        return text, spans

    def words(self, lang: str, n: int, capitals: bool = True) -> str:
        """Common words in any order; in English also capitalised ones in a row, which are no names."""
        r = self.rng
        if lang == "ZH":
            return "".join(r.choice(self.names["words_zh"]) for _ in range(n))
        if lang == "EN" and capitals and r.random() < 0.35:
            return " ".join([r.choice(self.names["words_en"]), *(r.choice(self.names["capitals"]) for _ in range(r.choice([1, 2, 2, 3]))), r.choice(self.names["words_en"])])
        out = " ".join(r.choice(self.names[f"words_{lang.lower()}"]) for _ in range(n))
        return out[0].upper() + out[1:] if capitals and r.random() < 0.5 else out

    def _mark(self, text: str, lang: str) -> str:
        """What stands between two sentences: mostly a mark, now and then a line end or nothing."""
        r = self.rng
        if not text or text[-1] in "，。：；、？！\n ":
            return ""
        if r.random() < 0.07:
            return "\n"
        if lang == "ZH":
            return r.choice(["，", "。", "。", "，", "；", "", "！", "？", " "])
        return " " if text[-1] in ".,;:?!" else r.choice([". ", ". ", ", ", "; ", "! ", "? ", " - "])
