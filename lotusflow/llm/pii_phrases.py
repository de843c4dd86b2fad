"""Word lists and sentence patterns the recognition of personal information is trained on.

Everything here is general knowledge, written for any corpus: common names of several
countries, kinds of places and firms, and everyday sentences around them. Slots: {N}
name, {T} title, {P} phone, {E} email, {I} identity number with {Q} its label, {A}
address are personal; {L} a place with its kind, {G} a place, {F} a firm or street named
after a person, {D} a digit string of another kind, {C} letters with digits, {M} a small
number, {W} a few capitalized words that name no person.
"""

from __future__ import annotations

#: Common Vietnamese family names.
SURNAMES = (
    "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý Đinh Lâm Mai Trịnh Đoàn Tạ Hà Cao Lương"
    " Đào Tô Châu Thái Tống Quách Vương La Kiều Lưu Triệu Từ Phùng Tăng Chu Văn Hứa Quan Ninh Khúc Giáp Bạch Thạch Sầm Nông Doãn Nghiêm Mạc Đàm Ông Lều Phí Tôn Viên Vi Lò Hầu"
).split()

#: Common Vietnamese given and middle names.
GIVEN = (
    "An Anh Bảo Bích Bình Châu Chi Cúc Cường Dung Dũng Duy Duyên Đạt Đông Đức Giang Hà Hải Hằng Hạnh Hiền Hiếu Hòa Hoa Hoài Hùng Huy Huyền"
    " Hương Khánh Khang Khoa Khôi Kiên Kim Lan Liên Linh Loan Lộc Long Ly Mai Mạnh My Mỹ Nam Nga Ngân Nghĩa Ngọc Nguyên Nhân Nhật Nhi Nhung Oanh"
    " Phong Phú Phúc Phương Quân Quang Quốc Quỳnh Sang Sơn Tài Tâm Tân Thái Thắng Thanh Thành Thảo Thi Thịnh Thu Thư Thủy Tiến Tín Toàn Trang Trí Trinh Trúc Trung Tú Tuấn Tùng Tuyết Uyên Vân Việt Vinh Vy Xuân Yến"
).split()
MIDDLE = "Văn Thị Bá Gia Hữu Đức Quốc Thanh Thùy Thục Ngọc Bảo Minh Xuân Công Đình Hoàng Kim Mỹ Như Phương Quang Thế Trọng Tuấn Viết".split()

#: Common given and family names of other countries.
FOREIGN_FIRST = (
    "Michael David Sarah Emily James Robert William Thomas Daniel Matthew Anna Julia Sophie Claire Pierre Marie Jean Antoine Camille Hans Klaus"
    " Jürgen Stefan Katrin Heike Carlos Miguel Lucía María José Sofía Marco Giulia Luca Paolo Ivan Dmitri Olga Natasha Sergei Piotr Ewa Yuki Kenji"
    " Haruto Sakura Wei Li Mei Jun Min-ho Ji-woo Priya Arjun Rahul Ahmed Fatima Omar Aisha Lars Ingrid Erik Astrid Patrick Siobhan Liam Chloe Olivia Noah Emma Grace Henry Alice"
).split()
FOREIGN_LAST = (
    "Thompson Anderson Wilson Taylor Moore Martin Clark Lewis Walker Hall Young King Wright Scott Green Baker Lefebvre Durand Moreau Laurent Fontaine"
    " Schneider Fischer Hoffmann Becker Vogel Zimmermann García Martínez López Sánchez Romano Colombo Ricci Petrov Volkov Sokolova Nowak Wójcik Tanaka"
    " Suzuki Watanabe Yamamoto Zhang Wang Chen Liu Kim Park Choi Sharma Patel Singh Khan Hassan Hansen Johansson Nilsson O'Connor McCarthy Smith-Jones Van-Dijk Fraser Campbell"
).split()

#: Letters from which names of no known language are put together.
ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sh st t th tr v w z".split()
VOWELS = "a e i o u ai ea ee ie oo ou".split()
CODAS = " l ld n nd ng r rd rn s sk st t x ck m mb".split(" ")

#: Beginnings and rimes of Vietnamese syllables.
VI_ONSETS = "b c ch d đ g gi h kh l m n ng nh ph qu r s t th tr v x".split() + [""]
VI_RIMES = (
    "an ân ăn ang ăng anh ánh ạnh ao ào áo at ạc ắc ậu ấu ẩn ấn ên iên iền iến iệt iêu iếu im in inh ình ích oa oài oan oàn ong òng ông ốc ôn ơn ơi"
    " ỏi òi u ú ùa ụa ùng úc ực ương ường ướng ước ưu ựu uân uệ uê uyên uyền uyến uyết y ỳ ỷ ỹ ậy ấy"
).split()

TITLES = "anh chị ông bà cô chú bác em thầy dì cậu Anh Chị Ông Bà Cô Mr. Mrs. Ms. Dr. Miss Mr Mrs M. Mme Herr Frau Sr. Sra.".split()

#: Words for kinds of places and of firms, before the name in Vietnamese.
PLACE_KINDS = (
    "núi|đồi|hồ|suối|thác|vịnh|đảo|bãi|chợ|chùa|làng|rừng|động|đèo|bến|đầm|cù lao|phố cổ|sông|biển|cầu|đền|đình|miếu|lăng|tháp|hang|vườn|công viên|quảng trường|khu du lịch|khu nghỉ dưỡng|nhà thờ|sân bay|ga|cảng|thung lũng|cao nguyên|thị trấn|xã|huyện|bản|ghềnh|mũi|hòn|phá|vườn quốc gia"
).split("|")
STREET_KINDS = "đường|phố|ngõ|hẻm|đại lộ|quốc lộ|ngã tư|phường|quận".split("|")
FIRM_KINDS = (
    "công ty|khách sạn|nhà hàng|quán|trường|bệnh viện|bảo tàng|ngân hàng|hãng|tiệm|nhà sách|công ty TNHH|công ty cổ phần|công ty du lịch|nhà xe|homestay|trung tâm|tập đoàn|xưởng|hợp tác xã|trường tiểu học|nhà nghỉ|quỹ|giải|lễ hội|tượng đài|đoàn|câu lạc bộ"
).split("|")

#: Names of provinces and cities.
CITIES = (
    "Hà Nội|Hồ Chí Minh|Đà Nẵng|Hải Phòng|Cần Thơ|Huế|Nha Trang|Đà Lạt|Vũng Tàu|Quy Nhơn|Hạ Long|Hội An|Sa Pa|Ninh Bình|Phan Thiết|Buôn Ma Thuột|Vinh|Thanh Hóa|Nam Định|Thái Nguyên|Biên Hòa|Long Xuyên|Rạch Giá|Cà Mau|Pleiku|Kon Tum|Lào Cai|Hà Giang|Cao Bằng|Lạng Sơn|Bắc Ninh|Đồng Hới|Tuy Hòa|Mỹ Tho|Tây Ninh"
).split("|")

#: Heads and ends from which other place names are put together.
PLACE_HEADS = "An Bình Cẩm Đông Hải Hòa Hưng Kim Lạc Lộc Long Mỹ Nam Phú Phước Quảng Sơn Tam Tân Thanh Thạnh Thủy Tiên Trung Trường Vĩnh Xuân Yên".split()
PLACE_ENDS = "Bình Châu Điền Định Đông Giang Hải Hòa Hưng Khánh Lâm Long Lộc Minh Ninh Phong Phú Phước Sơn Tây Thành Thạnh Thịnh Thủy Trung Vân Xuyên Xá".split()

#: Words for roles of people, in Vietnamese and English.
ROLES = "hướng dẫn viên|tài xế|lễ tân|bạn|đầu bếp|chủ nhà|trưởng đoàn|nhiếp ảnh gia|cô giáo|cụ|nghệ nhân|lái đò|phóng viên|bạn đồng hành|em trai tôi|vợ tôi|bố tôi|chủ thuyền|nhân viên".split("|")
ENGLISH_ROLES = "captain cook driver host guide friend boatman neighbour colleague teacher photographer manager owner landlady instructor".split()

#: Labels of identity numbers.
LABELS = (
    "CCCD", "CMND", "căn cước", "số căn cước", "căn cước công dân", "thẻ căn cước", "chứng minh thư", "chứng minh nhân dân", "số CCCD", "số CMND", "hộ chiếu",
    "số hộ chiếu", "passport", "Passport", "passport no.", "ID", "ID card", "identity card", "citizen ID", "national ID", "CCCD", "CMND", "hộ chiếu", "số định danh",
)

PERSONAL = """
Họ và tên: {N}
Họ tên: {N}, điện thoại: {P}
Tên tôi là {N}.
Mình là {N}, hiện sống tại {A}.
Tôi tên {N}, số điện thoại {P}.
Người gửi: {N}
Người nhận: {N}, {A}
Người nhận {N}, địa chỉ {A}, số máy {P}
Khách hàng {N} đã thanh toán.
Khách: {N} ({P})
Xin gặp {T} {N} ở quầy lễ tân.
Cảm ơn {N} đã chia sẻ.
Cảm ơn {T} {N} rất nhiều!
Theo {N}, nơi này đông nhất vào cuối tuần.
Theo {T} {N}, giá sẽ tăng.
Bài và ảnh: {N}
Bài viết của {N}
Ảnh: {N}
Ý kiến của {N}: rất đáng đi.
Câu hỏi của {T} {N} gửi tới ban biên tập.
{N} viết:
{N} cho biết sẽ quay lại vào năm sau.
{N} nói rằng phòng sạch sẽ.
{N} là hướng dẫn viên của đoàn.
{N} đã đặt phòng cho hai người.
Hôm qua {N} đưa chúng tôi đi chơi.
Sáng nay {N} và {N} cùng ra bến.
Chúng tôi gặp {N} trên tàu.
Phòng này do {T} {N} quản lý.
Chương trình do {N} dẫn.
Tác giả {N} sinh ra ở {G}.
Tài xế tên {N}, biển số sẽ gửi sau.
{R} {N} vui tính và chu đáo.
{R} {N} đón cả nhà từ sớm.
Nhờ {R} {N} mà mọi việc xong sớm.
Mình hỏi {R} {N} thì biết đường.
Gặp {R} {N}, ai cũng thấy ấm lòng.
Đi với {R} {N} thì yên tâm.
Our {O}, {N}, made tea.
The {O} {N} met us early.
My {O} {N} knows the way.
I thanked our {O} {N} twice.
Look for {N} at the gate.
A letter for {N} is waiting.
{N} has the tickets.
{N} gave us a map.
Hướng dẫn viên: {N}. Điện thoại: {P}.
Đại diện: {T} {N}
Liên hệ: {T} {N} - {P}
Liên lạc {N}: {P}
Gọi cho {N} trước khi đến.
Hãy gọi {P} để đặt bàn.
Số của tôi là {P}.
SĐT: {P}
ĐT {P}
Hotline: {P}
Tel: {P}
Phone: {P}
Gọi ngay {P} hoặc nhắn tin {P}.
Zalo {P}
Nhắn số {P} giúp mình.
Đặt bàn qua số {P}.
Đặt vé với {T} {N} qua số {P}.
Bấm số {P} để gặp lễ tân.
Khách gọi theo số {P} sau 8 giờ.
Máy bàn {P}, di động {P}.
Email: {E}
Thư điện tử: {E}
Gửi hồ sơ về {E} nhé.
Mail cho mình: {E}
Bạn viết cho {E} để hỏi thêm.
{N}, {E}, {P}
{N} | {P} | {E}
{N} - {P} - {E}
{N} - {P}
{M}; {N}; {P}
{N}; {A}; {P}
{N}; {Q}{I}; {E}
{M}. {N}; {Q}{I}; {P}.
{N} ({E})
Đã nhận của {N}, {Q}{I}.
{T} {N}, {Q}{I}, thường trú {A}.
{Q}{I}
{Q}{I} cấp ngày {M}/{M}.
Giấy tờ: {Q}{I}, tên {N}.
Nhặt được giấy tờ mang tên {N}, {Q}{I}.
Mất ví, trong có {Q}{I}. Ai thấy gọi {P}.
Làm thủ tục cần {Q}{I}
Danh sách: 1. {N}, {Q}{I}; 2. {N}, {Q}{I}
Địa chỉ: {A}
Địa chỉ nhà: {A}.
Nhà tôi ở {A}.
Tôi sống ở số {A} từ nhỏ.
Giao hàng tới {A} trước giờ trưa.
Gửi về {A} giúp em.
Hẹn gặp ở {A} lúc {M} giờ.
Trụ sở cũ đặt tại {A}, nay đã dời.
Mời ghé {A}!
Chỗ ở: {A}; người đón: {N}.
Thân ái,
{N}
Trân trọng,
{N}
{P}
Ký tên: {N}
My name is {N}.
This is {N} speaking, my number is {P}.
Contact {N} at {P}.
Contact person: {N}
Please ask {N} for the keys.
Call me on {P}.
Call {P} or write to {E}.
You can reach us at {E}.
Send it to {E} by Friday.
Guest name: {N}, {Q}{I}
Passenger: {N}
Reserved for {N}.
Booked under {N}, {P}
Thanks to {N} for the ride.
Written by {N}
Photos by {N}.
According to {N}, the beach is quiet.
{T} {N} will meet you at the station.
{N} was our guide and told great stories.
{N} said the rooms were clean.
{N} wrote on Monday:
We met {N} on the boat.
Yesterday {N} took us around.
Our driver {N} waited for an hour.
She lives at {A}.
Ship to {A}.
Address: {A}
Best regards,
{N}
Cheers, {N}
Merci à {N} pour son aide.
Écrit par {N}
Votre guide, {N}, vous attend.
Geschrieben von {N}.
Danke an {N} für alles.
Ihre Gastgeberin {N}, Telefon {P}
Gracias a {N} por la visita.
Contacto: {N}, {P}
"""

OTHER = """
{F} mở cửa hằng ngày.
Chúng tôi ăn tối ở {F}.
Từ {F} đi bộ tới {L} mất {M} phút.
Nhà xe đón khách gần {F}.
{L} đẹp nhất vào mùa thu.
{L} được nhiều người biết đến.
{L} được trùng tu hai lần.
{L} nổi tiếng vì yên tĩnh.
{L} rộng {M} ha.
{L} và {L} đều đáng đi.
{L} hay {L} đẹp hơn?
{L} lies north of {G}.
{L} is a quiet place.
Nước {L} trong và mát.
Hồi xưa {L} là bến thuyền.
Tên {L} có từ lâu đời.
Cái tên {L} gợi nhớ chuyện cũ.
Cá ở {L} rất ngon.
Sương ở {L} tan muộn.
Xuân về, {L} đầy hoa.
Hơn cả {L}, {L} còn giữ nét xưa.
Prices at {L} are fair.
Unlike {L}, {L} has a pier.
{L} cách {G} chừng {M} km.
Đi {G} mùa nào đẹp?
Tuần tới mình đi {G} và {G}.
Chuyến {G} - {G} khởi hành lúc {M} giờ.
Vé từ {G} ra {L} bán ở bến.
Đường lên {L} hơi dốc.
Dân {G} mến khách.
Ở {G} có nhiều món ngon.
Người dân {L} sống bằng nghề chài.
Thời tiết {G} hôm nay nắng.
{G} nằm ven biển.
{G}, {G} và {G} là ba điểm dừng.
Tối nay ở {G} có chợ đêm.
Trung tâm {G} đông vào cuối tuần.
Khách sạn nằm trên {F}.
Rẽ trái vào {F} rồi đi thẳng.
Lễ hội ở {L} tổ chức vào tháng {M}.
Bản đồ {G} phát ở sân bay.
Mã đơn hàng: {D}
Mã đơn {D} đã giao.
Hóa đơn số {D} ngày {M}/{M}.
Số tài khoản {D}, ngân hàng sẽ xác nhận.
Mã vận đơn {D} đang trên đường.
Số vé {D}
Số sê-ri {D}.
Mã số thuế {D}
Lô hàng {D}, hạn dùng {M} tháng.
Vé số {D} trúng giải.
Tra cứu mã {D} trên trang.
Mã đặt chỗ {C}
Số hiệu {C} đã đổi.
Mã phiếu {C}, quầy số {M}.
Lô {C}
Booking code {C}.
Order number {D} was shipped.
Invoice {D} is paid.
Tracking number {D}
Serial no. {D}
Ticket {D}, seat {M}A.
Reference {D}, lot {C}
ISBN {D}
Tọa độ {M}.{D}, {M}.{D}
Giá {M}.000.000 đồng, cọc {M}00.000 đồng.
Giá từ {M}50.000 VND đến {M}90.000 VND.
Tổng cộng {M}.250.000đ.
Ngân sách {M}.125.000.000 đồng cho hai năm.
Khẩn cấp gọi 113, 114 hoặc 115.
Emergency numbers are 112 and 911.
Theo dõi @{W} trên mạng.
Trang fanpage @halong{M} có ảnh mới.
Combo 3@{M}90k chỉ hôm nay.
Hẹn nhau @ cổng số {M}.
Xe biển số {M}A-{M}3.45 đỗ ở bãi.
Từ {M}/{M}/2024 đến {M}/{M}/2025 có {M} chuyến.
Giờ mở cửa: {M}:00 - {M}:30.
{W} mở bán từ thứ hai.
{W}: kinh nghiệm từ A đến Z
# {W}
# {L}
## {G}
# Kinh nghiệm {G}
{W} là món nên thử.
Xem phim {W} ở rạp.
Chương trình {W} kéo dài {M} ngày.
Ăn ở {G}
Đặc sản {G}: bánh, mứt và trà.
từ lâu mai vàng nở rộ quanh hồ, cao hơn mái nhà.
hà cớ gì phải vội, lý do là trời còn sáng.
người lớn tuổi và người cao tuổi được giảm giá
cây cao bóng mát, núi cao mây phủ, giá vé cao hơn năm ngoái
đi từ sáng tới chiều, từ bến tàu tới chợ, từ tháng {M} trở đi
hồ nước trong xanh, hồ rộng và sâu, quanh hồ có nhiều quán
sáng mai trời đẹp, mai đi sớm, hoa mai nở
lý do giá tăng, theo lý thuyết thì gần hơn
phí vào cửa, phí gửi xe, lệ phí thấp
viên đá lớn, nhân viên thân thiện, công viên rộng
văn hóa lâu đời, khu phố văn minh
quan trọng nhất là giờ giấc, cơ quan mở cửa sớm
tăng giá vào dịp lễ, tăng thêm chuyến
chu đáo và nhiệt tình, chu kỳ hai năm
thái độ phục vụ tốt, món thái cay
la cà quán xá, tô phở nóng, tô màu
châu báu, châu Á, đào tạo nghề, hoa đào
an toàn là trên hết, bình minh trên biển, bình yên lắm
kiều bào về quê, vương vấn mãi, ninh xương thật lâu
nông dân trồng lúa, nông sản sạch, bạch tuộc nướng
lưu ý giữ gìn, quà lưu niệm, giấy lưu trú
Khách sạn lưu trú: {M} phòng
Khai báo lưu trú tại quầy
lương thực đầy đủ, lương tháng mười triệu, thái độ và thái cực
từ chối khéo, từ thiện, từ từ thôi, từ nay về sau
đoàn khách đông, đoàn tàu dài, đoàn viên, lâm nghiệp, lâm sản
hồ sơ gồm: đơn và ảnh, hồ bơi: mở cửa, hồ sen
cao cấp, cao điểm: tháng {M}, cao nguyên, cao tốc
mai sau, mai mốt, tô điểm, tô mì, trần nhà, trần gian
ngô rang, ngô nướng, bùi béo, đinh ốc, dương liễu, dương xỉ
tăng tốc, tăng cường, chu trình, châu lục, kiều mạch
đàm phán, ông chủ, văn bản: hai trang, văn nghệ, viên chức, vi phạm
phí dịch vụ: tính sau, phí bảo hiểm, khúc sông, bạch đàn, thạch rau câu
nghiêm túc, giáp ranh, quan sát, tôn trọng, nông trại, ninh nhừ
cao diem, tu thien, ho so, luu tru, luu y, thai do
vi vu gió biển, lò gạch cũ, hầu hết khách quen
Tổ chức {W} tài trợ cây xanh.
We stayed near {L}.
{G} is best in spring.
The road from {G} to {G} is long.
{W} opens at {M}.
Visit {L} and {L} on the way.
The {W} festival starts in May.
{W} Street is closed for repairs.
Museum of {W} has new rooms.
Trains leave {G} every {M} minutes.
Breakfast in {G} starts early.
{L} est à {M} km de {G}.
La vieille ville de {G} est calme.
Le Musée National ouvre à {M} h.
{L} liegt westlich von {G}.
Der Markt in {G} öffnet um {M} Uhr.
Das Wetter bleibt schön, die Straßen sind leer.
{L} está cerca de {G}.
El Mercado abre temprano.
{L} находится недалеко от {G}.
{L}는 {G}에서 가깝습니다.
{L}は{G}の近くです。
{L}离{G}很近。
IT'S NOT FAR FROM {G}, THEY'RE CLOSED TODAY.
MỞ CỬA CẢ TUẦN, GIÁ RẺ.
VÉ NGƯỜI LỚN {M}0.000 ĐỒNG
Thứ Hai, Thứ Ba và Thứ Tư nghỉ.
Tháng Giêng ít mưa. Mùa Xuân về sớm.
Ban Quản Lý {L} thông báo.
Ủy Ban Nhân Dân {G} cho phép.
"""

#: Capitalized words that name things, for the slot {W}.
THINGS = (
    "Lễ Hội Ánh Sáng|Bánh Mì Nóng|Phở Bò Tái|Cà Phê Sữa Đá|Hành Trình Xanh|Đêm Hội Trăng Rằm|Chợ Nổi|Bún Bò|Tuần Lễ Văn Hóa|Du Lịch Bền Vững|Bãi Biển Đẹp|Làng Nghề|Mùa Lúa Chín|Vé Khứ Hồi|Nhà Hát Lớn|Bưu Điện Trung Tâm|Cột Cờ|Xe Buýt Hai Tầng|Ẩm Thực Đường Phố|Thuyền Kayak|Golden Coast|Old Town|Green Market|Night Bazaar|River Park|Summer Music|Ocean View|Central Station|Blue Lagoon|High Season|Grand Palace|Art House|Silk Road|Great Wall|Street Food|City Tour|Happy Hour|New Year|Black Coffee|Red Lantern"
).split("|")
